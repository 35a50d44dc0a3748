"""Lexicons of the word rules: own terms, in the shape (rule_type, term, replacement, severity, case_sensitive).

`read` takes a deployment's own lexicons instead: a folder of CSV files with those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "rule_type string, term string, replacement string, severity string, case_sensitive boolean"

#: A to Z word lists: wrong|right pairs; the first word's letter names the rule.
WORD_USAGE = """
a lot|many; abort|stop; above-mentioned|this; actioned|done; ad hoc|custom; afterwards|later; amongst|among
back-end|backend; bear in mind|note; blow away|remove; by means of|with; bug fix|correction
can not|cannot; carry out|do; checkbox list|list; cons|drawbacks; currently|now
data base|database; deselect|clear; drill down|open; due to the fact that|because
e-mail|email; end user|user; enable you to|let you; eyeball|check
fill in|enter; fire up|start; first of all|first; for the purpose of|for; front-end|frontend
get rid of|remove; given that|because; go ahead and|; grayed out|unavailable
hard-code|fix; hang|stop responding; hit|press; hence|so
in order to|to; in regard to|about; in terms of|for; invoke|call; is able to|can
jump to|go to; just|
keep in mind|note; kick off|start; kill|end; know-how|knowledge
last but not least|; lets|let us; leverage|use; like|such as; log in to|log into
make sure|check; master|main; may be able to|can; must have|requirement
native|built-in; nice to have|optional; note that|; nuke|delete
off-line|offline; on the fly|at run time; on-line|online; out of the box|by default
per|for each; pain point|problem; plug in|plugin; prior to|before; pros|advantages
quantum leap|advance; quite|; queue up|queue
rather|; real time|real-time; regardless of|despite; respective|own
sanity check|check; set-up|setup; simply|; slave|replica; some of the|some; sunset|retire
tear down|remove; thru|through; time-out|timeout; type in|enter
upon|on; use case|case; user-friendly|simple; utilize|use
versus|compared with; very|; via|through; vice versa|the reverse
want to|can; web-site|website; whether or not|whether; whilst|while; wish|want
x-ref|reference; xerox|copy
year over year|yearly; yet another|another
zero out|clear; zip up|compress
above|earlier; access|open; adopter|user; advise|suggest; afterward|later; aka|also called; allows you to|lets you; alright|all right; anyways|anyway; appears|is shown; application program|application; as well as|and
backward compatible|compatible with earlier versions; below|following; bleeding edge|newest; boot up|start; bottom line|result; brain dump|notes; breakdown|failure; bring up|open
cancel out|cancel; canned|predefined; catalog out|list; cutting edge|newest; close out|close; combo|combination; come up with|find; comprised of|made up of; crash|fail; cut over|switch
deep dive|close look; depress|press; desire|want; dialogue|dialog; disallow|prevent; due to|because of; dump|copy
easy|; effectuate|do; eliminate|remove; ensure that|make sure that; etcetera|; ever|; execute|run; exit out|exit
fall back|return; figure out|find; finalize|finish; foolproof|reliable; forthcoming|next; functionality|function
gotcha|problem; gotten|got; greenfield|new; grep for|search for; guesstimate|estimate
hack|change; hands-on|practical; head over to|go to; heads up|notice; hopefully|; hover over|point to
illegal|not valid; impact|affect; impacted|affected; input|enter; in lieu of|instead of; in the process of|; internet-based|online; irregardless|regardless; issue|problem
jumpstart|start; justify|explain
kludge|workaround; kill off|end
launch|start; lever|use; lightning fast|fast; look and feel|appearance; login|log in
mandatory|required; mash up|mix; may|can; mouse click|click; mission critical|essential; moving forward|from now on
nice|; noob|beginner; nowadays|now; numeric digits|digits
obsoleted|made obsolete; off of|from; okay|OK; on the other hand|but; once|after; one-off|single; orientate|orient; over|more than
perform|do; pinpoint|find; please|; power up|turn on; pre-built|built-in; press down|press; previous to|before; proactively|early; punch in|enter
queue|line; quick and dirty|rough; quirk|behavior
refer back|see; reboot up|restart; right-click on|right-click; rip out|remove; roll out|release; run into|meet
seamless|smooth; segue|move; shoot|send; since|because; spin up|start; straightforward|; super|; surf|browse
tap on|tap; tick|select; toggle|switch; towards|toward; trivial|; tweak|change; turnkey|ready
ultimately|; uncheck|clear; under the hood|internally; until such time as|until; usage of|use of
vanilla|standard; verbiage|text; vulnerable to|open to
whizzy|; wizard-driven|guided; workaround for|way around; world-class|; worst case|at worst
x-axis line|x-axis
yank|remove; you should|
zap|delete; zero in on|focus on; zoom by|zoom
"""

SIMPLE = """
accomplish|do; accordingly|so; additional|more; adequate|enough; advantageous|helpful; aggregate|total; allocate|assign; alleviate|ease; ameliorate|improve
anticipate|expect; apparent|clear; approximately|about; ascertain|find out; assistance|help; attain|reach; attempt|try; augment|increase; beneficial|useful
cognizant|aware; commence|start; component|part; comprise|include; concerning|about; consequently|so; constitute|make up; demonstrate|show; depart|leave
designate|name; determine|find; discontinue|stop; disseminate|spread; elucidate|explain; employ|use; encounter|meet; endeavor|try; enumerate|list
equitable|fair; erroneous|wrong; exhibit|show; expedite|speed up; expenditure|cost; facilitate|help; forward|send; furnish|give; identical|same; illustrate|show
implement|do; inception|start; indicate|show; initiate|start; magnitude|size; maintain|keep; methodology|method; modification|change; necessitate|need
numerous|many; objective|goal; obtain|get; operate|run; optimum|best; participate|take part; permit|let; portion|part; possess|have; preclude|prevent
proficiency|skill; provided that|if; purchase|buy; regarding|about; reimburse|pay back; relinquish|give up; remainder|rest; request|ask; reside|live
select|choose; subsequently|later; substantiate|prove; sufficient|enough; terminate|end; transmit|send; utilization|use; validate|check; viable|workable; visualize|picture
"""
#: British spellings come from stems by rule: (endings, stems).
SPELLING = (
    ("ise|ize ised|ized ises|izes ising|izing isation|ization", "organ real recogn custom final general initial local maxim minim normal optim priorit special standard summar synchron visual author categor central character emphas formal harmon item modern monet neutral organ parallel random serial token vector virtual"),
    ("yse|yze ysed|yzed yses|yzes ysing|yzing", "anal paral catal"),
    ("our|or ours|ors oured|ored ouring|oring", "behavi col fav hon lab neighb hum rum harb endeav flav vap"),
    ("re|er res|ers", "cent met theat lit fib calib"),
    ("lled|led lling|ling ller|ler", "trave cance mode labe signa channe leve fue pane tota"),
    ("ence|ense", "def lic off"),
    ("ogue|og ogues|ogs", "catal dial anal"),
)
SPELLING_MORE = "grey|gray; programme|program; ageing|aging; artefact|artifact; cheque|check; enrol|enroll; fulfil|fulfill; judgement|judgment; sceptical|skeptical; storey|story; tyre|tire"
TERMINOLOGY = "dialogue box|dialog; drop-down|list; hard drive|disk; home page|start page; pop-up window|dialog; pull-down menu|menu; radio button|option; screen shot|image; thumb drive|USB drive; tool tip|hint; combo box|list; command prompt|terminal; context menu|shortcut menu; desktop icon|icon; file extension|extension; hash sign|number sign; login screen|sign-in page; memory stick|USB drive; menu option|menu item; mouse over|point to; scroll bar|scrollbar; spin box|field; start up disk|boot disk; tick box|checkbox; web browser|browser"
INCLUSIVE = "blacklist|blocklist|high; whitelist|allowlist|high; man hours|person hours|medium; manpower|workforce|medium; grandfathered|legacy|medium; dummy|placeholder|low; cripple|disable|medium; sanity test|check|medium; chairman|chair|medium; mankind|people|medium; man-made|artificial|medium; middleman|intermediary|medium; housekeeping|maintenance|low; native feature|built-in feature|low; salesman|salesperson|medium; spokesman|spokesperson|medium; tribal knowledge|shared knowledge|medium; white hat|ethical|low; black hat|malicious|low; master branch|main branch|medium"
DO_NOT_USE = "and so on|; as appropriate|; at this point in time|now; basically|; etc|; in the near future|soon; obviously|; of course|; should be able to|can; and/or|or; as per|as in; be advised that|; for the reason that|because; in close proximity to|near; in the event that|if; it should be noted that|; needless to say|; on a regular basis|regularly; please be aware that|; the fact that|; with the exception of|except"
#: Closed compounds, by their parts; the open and the hyphenated forms are flagged.
COMPOUNDS = "back|space base|line check|box check|point check|sum code|base dash|board data|base data|set drop|down file|name fire|wall frame|work hand|shake hard|ware head|line host|name hyper|link key|board key|word land|scape life|cycle light|weight load|time look|up lower|case main|frame meta|data middle|ware mile|stone mother|board name|space net|work note|book over|flow over|head over|write pass|phrase pass|word pay|load play|back play|book port|folio road|map run|time screen|saver script|let snap|shot soft|ware source|book spread|sheet stake|holder stand|alone store|front sub|net table|space task|bar time|line time|out time|stamp tool|bar tool|box tool|kit touch|screen trouble|shoot type|face upper|case user|name walk|through web|page web|site white|space wild|card work|around work|flow work|load work|place work|space work|station"
COMPOUND_MORE = "back up copy|backup copy; command-line interface|command line interface"
CONVERSATIONAL = "cease|stop; endeavour|try; furthermore|also; henceforth|from now on; hereafter|from now on; hereby|; herein|here; heretofore|until now; hitherto|until now; inasmuch as|because; inquire|ask; moreover|also; nevertheless|but; nonetheless|but; notwithstanding|despite; peruse|read; pursuant to|under; shall|must; thereafter|then; thereby|so; therefore|so; therein|in it; thereof|of it; thus|so; whereas|while; whereby|by which; whereupon|then; whosoever|whoever"
GEOGRAPHIC = "america|the United States; england|the United Kingdom; holland|the Netherlands; burma|Myanmar; czech republic|Czechia; swaziland|Eswatini; bombay|Mumbai; calcutta|Kolkata; peking|Beijing; the ukraine|Ukraine"

#: Terms that are inflected, with their replacement; a term not named here is listed as it is.
VERBS = "utilize leverage commence terminate facilitate demonstrate implement initiate obtain attempt purchase transmit allocate alleviate augment designate determine discontinue illustrate indicate furnish possess request reside validate invoke execute perform finalize eliminate encounter expedite participate exhibit cease inquire"
NOUNS = "blacklist whitelist middleman chairman salesman component objective methodology modification portion expenditure gotcha kludge quirk combo"
#: Forms (third person, past, -ing; plural alone for nouns) that the rule of endings would get wrong.
IRREGULAR = {
    "begin": ("begins", "began", "beginning"), "buy": ("buys", "bought", "buying"), "do": ("does", "did", "doing"), "find": ("finds", "found", "finding"), "get": ("gets", "got", "getting"),
    "give": ("gives", "gave", "giving"), "have": ("has", "had", "having"), "let": ("lets", "let", "letting"), "make": ("makes", "made", "making"), "meet": ("meets", "met", "meeting"),
    "run": ("runs", "ran", "running"), "send": ("sends", "sent", "sending"), "show": ("shows", "showed", "showing"), "stop": ("stops", "stopped", "stopping"),
    "chairman": ("chairmen",), "middleman": ("middlemen",), "salesman": ("salesmen",), "salesperson": ("salespeople",), "intermediary": ("intermediaries",),
}


def forms(word: str, verb: bool) -> tuple[str, ...]:
    """Third person, past and -ing of a verb, or the plural of a noun, by its ending."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    soft = word.endswith("y") and word[-2:-1] not in "aeiou"
    s = word[:-1] + "ies" if soft else word + ("es" if word.endswith(("s", "x", "z", "ch", "sh")) else "s")
    if not verb:
        return (s,)
    return s, word[:-1] + "ied" if soft else word + ("d" if word.endswith("e") else "ed"), (word[:-1] if word.endswith("e") and not word.endswith("ee") else word) + "ing"


def inflected(listed: list[tuple]) -> list[tuple]:
    """The rows and their inflected forms; a form that is listed already keeps its own entry, a replacement of several words stays as it is."""
    known, out = {(r[0], r[1]) for r in listed}, list(listed)
    for rule, term, replacement, *more in listed:
        verb = term in VERBS.split()
        if verb or term in NOUNS.split():
            plain = not replacement or " " in replacement
            for form, other in zip(forms(term, verb), forms(term, verb) if plain else forms(replacement, verb), strict=True):
                if (rule, form) not in known:
                    known.add((rule, form))
                    out.append((rule, form, replacement if plain else other, *more))
    return out


def _pairs(text: str) -> list[list[str]]:
    return [[part.strip() for part in entry.split("|")] for entry in text.replace("\n", ";").split(";") if entry.strip()]


def spellings() -> list[list[str]]:
    """Pairs of a British spelling and the American one, each once."""
    found = {}
    for endings, stems in SPELLING:
        for wrong, right in (e.split("|") for e in endings.split()):
            found |= {stem + wrong: stem + right for stem in stems.split()}
    return [list(p) for p in (found | dict(_pairs(SPELLING_MORE))).items()]


def compounds() -> list[list[str]]:
    parts = [c.split("|") for c in COMPOUNDS.split()]
    return [[f"{a}{gap}{b}", a + b] for a, b in parts for gap in (" ", "-")] + _pairs(COMPOUND_MORE)


def rows() -> list[tuple]:
    """The built-in lexicon: under two thousand rows, fixed."""
    out = [(f"word_usage_{e[0][0]}", e[0], e[1], "medium", False) for e in _pairs(WORD_USAGE)]
    lists = (("simple_words", _pairs(SIMPLE), "low"), ("spelling", spellings(), "medium"), ("terminology", _pairs(TERMINOLOGY), "medium"), ("do_not_use", _pairs(DO_NOT_USE), "high"), ("compound_words", compounds(), "medium"), ("conversational_style", _pairs(CONVERSATIONAL), "low"), ("geographic_terms", _pairs(GEOGRAPHIC), "medium"))
    for rule, pairs, severity in lists:
        out += [(rule, e[0], e[1], severity, False) for e in pairs]
    out += [("inclusive_language", e[0], e[1], e[2], False) for e in _pairs(INCLUSIVE)]
    return list(dict.fromkeys(out))


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A deployment's lexicons: CSV files with a header and the columns of SCHEMA."""
    return spark.read.schema(SCHEMA).option("header", True).csv(folder)


def known_terms(lexicon: DataFrame) -> DataFrame:
    """The registry of known terms: all replacements, as single words, without repeats."""
    return lexicon.where("replacement <> ''").selectExpr("lower(replacement) AS term").distinct()
