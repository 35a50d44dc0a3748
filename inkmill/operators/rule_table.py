"""The rule catalogue: one entry for each check of each pattern rule.

Patterns are read alike by Java and RE2. `word` asks for no letter, digit or underscore on either side of a find; `has`
and `lacks` are patterns on the whole sentence; `before` and `after` are characters that must not adjoin a find;
`only` keeps and `never` drops finds by their lower-cased text. `yes` and `no` are specimens, flagged and not flagged.
`blocks` limits a check to block types. Status: live, dormant (needs a parser's tags in other engines) or unreachable
(in no block type's list); all of them run here, and `parity` mode leaves out those that are not live.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_type: str
    check: str
    pattern: str
    message: str
    severity: str = "medium"
    word: bool = False
    has: str = ""
    lacks: str = ""
    before: str = ""
    after: str = ""
    only: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()
    status: str = "live"
    yes: str = ""
    no: str = ""


CODE = "`[^`]*`"
HEAD, ITEM, NOTE = ("heading",), ("list_item", "list_item_ordered", "list_item_unordered"), ("admonition",)
ADMONITIONS = ("note", "tip", "important", "warning", "caution")
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
UNITS = "mm|cm|km|m|kg|g|mg|ml|l|ms|s|min|h|Hz|kHz|MHz|GHz|B|KB|MB|GB|TB|KiB|MiB|GiB|TiB|kbps|Mbps|Gbps|W|kW|V|mV|A|mA|Pa|kPa|mph"
PARTICIPLE = "(?:[A-Za-z]{3,}ed|[a-z]{2,}wn|made|done|given|taken|built|sent|set|found|held|kept|written|run)"
BE = "(?:am|is|are|was|were|be|been|being)"

RULES: tuple[Rule, ...] = (
    # audience and medium
    Rule("accessibility", "all_caps", "[A-Z]{5,}", "Capitals for emphasis are hard to read aloud.", "low", word=True, status="dormant", yes="This is STRICTLY forbidden.", no="The HTTP port is open."),
    Rule("accessibility", "colour_only", "(?i)(?:shown|marked|displayed|highlighted) in (?:red|green|blue|yellow|orange|grey)", "Colour must not be the only sign.", status="dormant", yes="Errors are marked in red.", no="Errors are marked with a cross."),
    Rule("accessibility", "sensory_direction", "(?i)(?:on the (?:left|right)(?: side)?|at the (?:top|bottom) of the (?:page|screen)|(?:upper|lower) (?:left|right) corner)", "A place on the screen is no help to every reader.", "low", status="dormant", yes="Use the menu on the left side.", no="Use the File menu."),
    Rule("global_audiences", "negation", "(?i)(?:is|are|was|were|do|does|did|can|could|will|would|should)(?: not|n['’]t)", "Say what is, not what is not.", "low", word=True, status="dormant", yes="This does not work.", no="This fails."),
    Rule("global_audiences", "politeness", "(?i)(?:please|kindly|thank you)", "Instructions need no politeness formula.", "low", word=True, status="dormant", yes="Please close the lid.", no="Close the lid."),
    Rule("global_audiences", "self_reference", "(?i)(?:we recommend|we suggest|we advise|our recommendation)", "Recommend directly.", "low", word=True, status="dormant", yes="We recommend a restart.", no="Restart the host."),
    Rule("global_audiences", "expletive", "^(?i)(?:there|it) (?:is|are|was|were) ", "The sentence opens without its subject.", "low", status="dormant", yes="There are three modes.", no="Three modes exist."),
    Rule("global_audiences", "double_negative", "(?i)(?:not|never|no)[^.,;]{1,30} (?:un[a-z]{3,}|without|nothing|none)", "Two negations make the reader count.", "low", status="dormant", yes="It is not uncommon.", no="It is common."),
    Rule("obvious_terms", "field", "(?i)(?:enter|type|specify) (?:your|the|a) (?:name|address|e-mail|phone number|password|city|country) in the (?:name|address|e-mail|phone number|password|city|country) field", "The field's name says it already.", "low", yes="Enter your name in the Name field.", no="Enter the quota in the Limit field."),
    Rule("tone", "jargon", "(?i)(?:low-hanging fruit|move the needle|boil the ocean|circle back|deep dive|game changer|best of breed|think outside the box|at the end of the day|touch base)", "Business jargon.", word=True, lacks="[\"“][^\"”]*(?:fruit|needle|ocean|dive|changer|breed|box)[^\"”]*[\"”]", status="dormant", yes="Let us circle back later.", no="Let us talk later."),
    Rule("tone", "marks", "[!]{2,}", "Several marks shout.", status="dormant", yes="Stop!!", no="Stop!"),
    # language and grammar
    Rule("abbreviations", "latin", "(?:e\\.g\\.|i\\.e\\.|etc\\.|viz\\.|cf\\.|et al\\.)", "Write the Latin abbreviation out.", yes="Use a tool, e.g. a saw.", no="Use a tool such as a saw."),
    Rule("abbreviations", "undefined", "[A-Z]{2,6}", "Spell the abbreviation out at first use.", word=True, never=("api", "url", "http", "html", "pdf", "usb", "cpu", "ram", "id", "ok"), lacks="\\([A-Z]{2,6}\\)", status="dormant", yes="The QRT signal rises.", no="The URL opens."),
    Rule("adverbs_only", "only", "(?i)only (?:[a-z]+s|[a-z]+ed|use|run|start|stop|open|show|work|apply) ", "Set only next to what it limits.", "low", word=False, yes="It only works with files.", no="It works with files only."),
    Rule("anthropomorphism", "lets_you", "(?i)(?:allows|enables|lets|permits) (?:you|users|the user|customers)", "The product takes the reader's place.", "low", word=True, yes="The tool allows you to export.", no="You can export."),
    Rule("anthropomorphism", "human_verb", "(?i)(?:system|server|program|application|software|tool|file|database|script) (?:thinks|knows|wants|believes|decides|remembers|likes|sees|understands|expects)", "A thing does what people do.", word=True, yes="The server knows the key.", no="The server stores the key."),
    Rule("articles", "a_before_vowel", "(?i)a [aeio][a-z]+", "an before a vowel sound.", word=True, never=("a one", "a once", "a european", "a unique", "a useful", "a usual", "a user"), yes="This is a apple.", no="This is an apple."),
    Rule("articles", "an_before_consonant", "(?i)an [bcdfgjklmnpqrstvwxyz][a-z]+", "a before a consonant sound.", word=True, yes="This is an banana.", no="This is a banana."),
    Rule("capitalization", "generic", "[a-z,] (?:Server|Database|Network|File|Folder|Cluster|Browser|Application|Internet|Website)", "A generic noun needs no capital.", "low", after="A-Za-z0-9_", status="dormant", yes="Restart the Server now.", no="Restart the server now."),
    Rule("capitalization", "names", "(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|english|german|french|spanish|europe|linux|python|kubernetes)", "A name needs a capital.", word=True, status="dormant", yes="It ends on monday.", no="It ends on Monday."),
    Rule("conjunctions", "since", "(?i)since (?:the|you|we|it|this|they) ", "because, where a reason is meant.", "low", lacks="[0-9]{4}|(?i)(?:year|month|week|day|version)", yes="Wait, since the job runs.", no="It ran since the year 1990."),
    Rule("conjunctions", "while", "(?i)while (?:the|you|we|it|this|they) ", "although, where no time is meant.", "low", lacks="(?i)(?:during|wait|running)", yes="It is fast, while the other is slow.", no="Wait while the job ends."),
    Rule("conjunctions", "if_then", "(?i)if [^.;]{2,80}, then ", "then is not needed after if.", "low", yes="If it fails, then restart.", no="If it fails, restart."),
    Rule("contractions", "contraction", "(?i)(?:[a-z]+n['’]t|(?:i|you|we|they)['’](?:re|ve|ll|d|m)|(?:it|that|there|he|she|what|who|let)['’]s)", "Write the contraction out.", "low", word=True, status="dormant", yes="It doesn't start.", no="The user's file."),
    Rule("definitions", "undefined", "[A-Z]{3,5}s?", "Define the acronym before its use.", "low", word=True, lacks="\\([A-Z]{3,5}s?\\)|\\{[A-Z]{3}|[A-Z]{3,5}-[0-9]", never=("url", "api", "http", "html", "pdf", "xml", "json", "usb", "cpu", "ram", "sql", "dns"), yes="The ZQXs are full.", no="The ZQX unit (ZQX) is full."),
    Rule("plurals", "optional_s", "[A-Za-z]{2,}\\(s\\)", "Choose singular or plural.", status="dormant", yes="Open the file(s).", no="Open the files."),
    Rule("plurals", "uncountable", "(?i)(?:informations|softwares|hardwares|equipments|feedbacks|advices|middlewares|metadatas)", "This noun has no plural.", "high", word=True, status="dormant", yes="Read the informations.", no="Read the information."),
    Rule("plurals", "acronym_apostrophe", "[A-Z]{2,}['’]s (?:are|were|have)", "No apostrophe in an acronym's plural.", status="dormant", yes="The CPU's are hot.", no="The CPUs are hot."),
    Rule("plurals", "adjective", "(?i)(?:systems|users|files|servers|applications) (?:administrator|management|configuration|interface|directory)", "An attributive noun is singular.", "low", word=True, status="dormant", yes="Ask the systems administrator.", no="Ask the system administrator."),
    Rule("possessives", "caps", "[A-Z]{2,}['’]s", "No possessive of an abbreviation.", word=True, never=("nasa's", "ieee's"), status="dormant", yes="The API's limit.", no="NASA's limit."),
    Rule("prefixes", "closed", "(?i)(?:re|pre|non|un|sub|multi|inter|co)-[a-z]{3,}", "Close the prefix up.", "low", word=True, never=("re-create", "re-sign", "pre-empt", "co-op", "co-worker", "non-null"), status="dormant", yes="Then re-start it.", no="Then re-sign it."),
    Rule("prepositions", "needless", "(?i)(?:off of|inside of|outside of|meet up|continue on|start up|finish up|connect together|merge together|refer back|return back|print out)", "The particle adds nothing.", "low", word=True, yes="Take it off of the list.", no="Take it off the list."),
    Rule("pronouns", "first_person", "(?:I|[Ww]e|[Uu]s|[Oo]ur|[Mm]y|[Mm]e)", "Leave the writer out.", "low", word=True, lacks="[\"“]", yes="Then we start.", no="Then you start."),
    Rule("pronouns", "gendered", "(?i)(?:he|she|him|his|hers|he/she|s/he)", "Use a form without gender.", word=True, yes="The user saves his file.", no="The user saves the file."),
    Rule("using_clarity", "using", "(?i)(?:file|data|system|program|server|user|device|tool|report) using (?:the|a|an|your)", "Who is using? Say by using or that uses.", lacks="(?i)by using", yes="Open the file using the viewer.", no="Open it by using the viewer."),
    Rule("verbs", "passive", f"(?i){BE} (?:[a-z]+ly )?{PARTICIPLE}", "Passive voice.", word=True, never=("is based", "are based", "is located", "are located", "is required", "is interested", "was red", "is red"), yes="The file is deleted.", no="The tool deletes the file."),
    Rule("verbs", "future", "(?i)will(?: not)? [a-z]+", "Present tense is enough.", "low", word=True, yes="The lamp will blink.", no="The lamp blinks."),
    # legal
    Rule("claims", "claim", "(?i)(?:guarantees?|100% secure|completely safe|never fails|best in class|world-class|future-proof|bulletproof|easy to use)", "A claim without support.", word=True, lacks="(?i)(?:according to|tests show|measured|does not)", status="unreachable", yes="A bulletproof design.", no="Tests show a bulletproof design."),
    Rule("company_names", "short_name", "(?:Acme|Globex|Initech|Umbrella)", "Use the company's full name at first.", "low", word=True, lacks="(?:Acme|Globex|Initech|Umbrella),? (?:Inc|Corp|Ltd|LLC|Corporation)", status="unreachable", yes="Acme ships it.", no="Acme Corp ships it."),
    Rule("personal_information", "name_parts", "(?i)(?:christian name|first name|last name|maiden name|family name)", "Say given name or surname.", word=True, status="unreachable", yes="Enter your last name.", no="Enter your surname."),
    # numbers and measurement
    Rule("numbers_currency", "symbol", "[$€£¥] ?[0-9][0-9,.]*[0-9]?", "Name the currency by its ISO code.", lacks="(?:USD|EUR|GBP|JPY)", yes="It costs $20 a month.", no="It costs $20 (USD)."),
    Rule("numbers_currency", "multiplier", "[$€£¥][0-9.,]+ ?[KMB]", "Write the amount out.", after="A-Za-z", yes="They paid $3M for it.", no="They paid $3 Mega."),
    Rule("dates_and_times", "numeric_date", "[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})", "Day or month first? Write the month out.", before="0-9/", after="0-9/", yes="It ends on 03/04/2021.", no="It ends on 2021-04-03."),
    Rule("dates_and_times", "am_pm", "[0-9]{1,2}(?::[0-9]{2})? ?(?:AM|PM|am|pm)", "Write a.m. or p.m.", before="0-9", after="A-Za-z", lacks="^[0-9-]+T", yes="At 10:30 PM it stops.", no="At 10:30 p.m. it stops."),
    Rule("numbers_general", "thousands", "[0-9]{4,}", "Separate the thousands.", before="0-9.,:x#vV-", after="0-9.:-", never=tuple(str(y) for y in range(1990, 2031)), lacks="(?i)(?:port|0x[0-9a-f]+|version|year)", status="dormant", yes="It has 12000 rows.", no="It ended in 2020."),
    Rule("numbers_general", "leading_zero", "\\.[0-9]+", "Set a zero before the point.", before="0-9A-Za-z./", status="dormant", yes="A ratio of .5 is good.", no="A ratio of 0.5 is good."),
    Rule("numerals_vs_words", "start", "^[0-9]+ [a-z]", "A number that opens a sentence is a word.", lacks="^[0-9]+[.)] |^[0-9]+ (?:GB|MB|mm|cm|ms)", yes="3 files are open.", no="Three files are open."),
    Rule("units_of_measurement", "space", f"[0-9](?:{UNITS})", "A space goes before the unit.", before="A-Za-z_", after="A-Za-z0-9_", yes="It is 100mm wide.", no="It is 100 mm wide."),
    # punctuation
    Rule("colons", "space_before", "[A-Za-z] +:", "No space before a colon.", after="/:0-9", status="unreachable", yes="Do this : go.", no="Do this: go."),
    Rule("colons", "heading", ":$", "A heading ends without a colon.", blocks=HEAD, status="unreachable", yes="Overview:", no="Overview"),
    Rule("commas", "then", "[a-z] then ", "A comma goes before then.", lacks="(?i)(?:if|when|after|and|since|until) ", yes="Open it then close it.", no="Open it, then close it."),
    Rule("dashes", "em_dash", "—|--", "Use a comma, colon or brackets.", before="-", after="-A-Za-z0-9", yes="One — two.", no="Use --force here."),
    Rule("ellipses", "ellipsis", "…|\\.\\.\\.", "An ellipsis leaves the reader guessing.", "low", before="\\[.", after="\\].", yes="Wait... done.", no="As quoted [...] here."),
    Rule("exclamation_points", "mark", "!+", "No exclamation marks.", lacks="[\"“][^\"”]*!", after="=", yes="Done! Go.", no="Say \"Done!\" now."),
    Rule("hyphens", "ly", "(?i)[a-z]+ly-[a-z]+", "No hyphen after an adverb in -ly.", word=True, never=("early-stage", "family-owned", "only-child", "friendly-looking", "daily-use", "early-access"), yes="A newly-built host.", no="An early-stage host."),
    Rule("oxford_comma", "list", "(?i)[a-z]+, [a-z]+ (?:and|or) [a-z]+", "A comma goes before the last item.", "low", lacks=", (?:and|or) ", yes="Red, green and blue.", no="Red, green, and blue."),
    Rule("parentheses", "nested", "\\([^()]*\\([^()]*\\)[^()]*\\)", "Brackets within brackets.", "low", status="unreachable", yes="It (the host (old)) stops.", no="It (the host) stops."),
    Rule("periods", "dotted", "(?:[A-Za-z]\\.){2,}", "No periods in the abbreviation.", word=False, before="A-Za-z0-9.", never=("e.g.", "i.e.", "a.m.", "p.m.", "u.s."), yes="The U.S.A. office.", no="At 10 a.m. it opens."),
    Rule("periods", "double", "\\.\\.", "One period is enough.", before="./", after="./", yes="It ends.. here.", no="It ends... here."),
    Rule("punctuation_and_symbols", "symbol", " [&#+] ", "Write the sign as a word.", has="[a-z]", lacks="[A-Z][a-z]+ & [A-Z]|&[a-z]+;|https?://|[0-9] \\+ [0-9]", yes="Salt & pepper here.", no="Smith & Sons sell it."),
    Rule("quotation_marks", "outside", "[\"”][.,]", "Punctuation goes inside the quotes.", before="", status="unreachable", yes="He said \"go\".", no="He said \"go.\""),
    Rule("quotation_marks", "smart", "[“”‘]", "Use straight quotes.", status="unreachable", yes="He said “go”.", no="He said \"go\"."),
    Rule("semicolons", "adverb", "(?i), (?:however|therefore|moreover|otherwise|consequently|nevertheless),? ", "A semicolon goes before the adverb.", status="unreachable", yes="It failed, however it ran.", no="It failed; however, it ran."),
    Rule("semicolons", "long", ";", "Make two sentences.", has="(?:[^ ]+ ){25}", status="unreachable", yes="a b c d e f g h i j k l m n o p q r s t u v w x y z; and so on it goes.", no="Short; so is this."),
    Rule("slashes", "and_or", "[A-Za-z]+/[A-Za-z]+", "Say which of the two.", before="A-Za-z0-9/.:_~-", after="A-Za-z0-9/._-", never=("and/or", "i/o", "tcp/ip", "read/write", "client/server", "n/a", "24/7", "ci/cd"), lacks="(?i)https?://|(?:path|directory|folder)", yes="Pick red/green now.", no="Use TCP/IP now."),
    Rule("spacing", "double", "[^ ]  +[^ ]", "One space is enough.", "low", yes="Two  spaces here.", no="One space here."),
    Rule("spacing", "missing", "[a-z][,;:.][A-Z][a-z]", "A space is missing.", lacks="https?://|www\\.|[a-z]+\\.[A-Z][a-z]+\\(", yes="It ends.Then it starts.", no="It ends. Then it starts."),
    # references
    Rule("references_citations", "link_text", "(?i)(?:click here|read more|this link|see here|learn more here)", "Name what the link leads to.", "high", word=True, lacks="[\"“](?i)(?:click|read|this|see)", yes="To start, click here.", no="See Installing."),
    Rule("references_citations", "noun_capital", "(?:[Ss]ee|in) (?:Chapter|Section|Table|Figure|Appendix) [0-9A-Z]", "No capital on the reference's noun.", "low", yes="As shown in Table 4.", no="As shown in table 4."),
    Rule("references_citations", "abbreviation", "(?i)(?:fig|chap|sec|vol|pp)\\. ?[0-9]+", "Write the reference out.", before="A-Za-z", yes="See fig. 3 below.", no="See figure 3."),
    Rule("references_citations", "intro_comma", "(?i)for (?:more )?information[^,.]{0,30} see ", "A comma goes before see.", yes="For more information see the guide.", no="For more information, see the guide."),
    Rule("references_geographic", "outdated", "(?:Bombay|Peking|Burma|Ceylon|Constantinople|Czechoslovakia|Yugoslavia|Persia|Siam)", "The place has another name today.", "high", word=True, status="unreachable", yes="The Bombay office.", no="The Mumbai office."),
    Rule("references_names_titles", "title", "(?:the|a|an|our|their) (?:President|Director|Manager|Engineer|Administrator|Professor|Chief Executive Officer)", "No capital on a title without a name.", word=True, lacks="(?:President|Director|Manager|Professor) [A-Z][a-z]+", status="dormant", yes="Ask the Director today.", no="Ask the director today."),
    Rule("references_product_names", "misspelling", "(?:Javascript|Github|Gitlab|MySql|Postgresql|PostGres|Linkedin|Youtube|Wordpress|Macos|OSX|Mongodb)", "The product is written otherwise.", "high", word=True, lacks=CODE, yes="Push it to Github.", no="Push it to GitHub."),
    Rule("references_product_names", "abbreviation", "(?:k8s|JS|VSCode|PG)", "Write the product's name.", word=True, lacks=CODE, yes="Deploy it on k8s now.", no="Deploy it on Kubernetes now."),
    Rule("references_product_names", "possessive", "(?:Kubernetes|Linux|Python|Spark|Hadoop|Docker)['’]s?", "No possessive of a product.", after="A-Za-z", yes="Spark's planner runs.", no="The Spark planner runs."),
    Rule("references_product_versions", "dotted", "[Vv]\\. ?[0-9]+(?:\\.[0-9]+)*", "Only the number.", "high", before="A-Za-z0-9", lacks="(?i)(?:git|tag|changelog)", yes="Use V.1 of it.", no="Use 1.0 of it."),
    Rule("references_product_versions", "letter", "[Vv][0-9]+(?:\\.[0-9]+)*", "Only the number.", before="A-Za-z0-9/.", after="A-Za-z0-9_", lacks="(?i)(?:git|tag|changelog|https?:)", yes="Use v2.1 here.", no="Check out the tag v2.1 here."),
    Rule("references_product_versions", "word", "(?:Version|Release|Rel\\.) [0-9]+(?:\\.[0-9]+)*", "Only the number.", lacks="(?i)(?:git|tag|changelog)", yes="Install Version 3 now.", no="Install 3.0 now."),
    Rule("second_person", "third_person", "(?i)the (?:user|customer|reader|developer|client)", "Address the reader as you.", "low", word=True, lacks="(?i)(?:user (?:name|interface|id|account|group)|role|permission|client library)", yes="The user opens a file.", no="The user name is long."),
    # structure and format
    Rule("headings", "period", "\\.$", "A heading ends without a period.", blocks=HEAD, lacks="\\.\\.\\.$", yes="Getting started.", no="Getting started"),
    Rule("headings", "colon", ":$", "A heading ends without a colon.", blocks=HEAD, yes="Limits:", no="Limits"),
    Rule("headings", "leading_zero", "(?:^| )0[0-9]+", "No leading zeros.", blocks=HEAD, yes="Step 01", no="Step 1"),
    Rule("headings", "dash", " [-–—] ", "No dash in a heading.", blocks=HEAD, yes="Install - Linux", no="Install on Linux"),
    Rule("highlighting", "caps", "[A-Z]{6,}", "No capitals for emphasis.", "low", word=True, lacks=CODE, never=("https", "README"), yes="It is FORBIDDEN here.", no="It is forbidden here."),
    Rule("highlighting", "camel", "[a-z]+[A-Z][A-Za-z]*[a-z]", "Set code in code font.", "low", word=True, lacks=CODE, never=("iphone", "ebay", "macos", "javascript"), yes="Set maxSize to 4.", no="Set `maxSize` to 4."),
    Rule("highlighting", "bold_code", "\\*\\*?`[^`]+`\\*\\*?", "Code needs no bold.", yes="Run **`ls`** now.", no="Run `ls` now."),
    Rule("indentation", "mixed", "^(?: +\\t|\\t+ )", "Tabs and spaces are mixed.", blocks=("paragraph",), yes=" \tIndented line.", no="Plain line."),
    Rule("list_consistency", "period", "^[A-Z][^.!?:]*(?: [a-z]+){3,}[a-z]$", "A list item that is a sentence ends with a period.", "low", blocks=ITEM, has="(?i) (?:is|are|has|have|can|must|should|runs|opens) ", yes="The host is up and well now", no="The host is up and well now."),
    Rule("list_parallelism", "passive", f"(?i){BE} {PARTICIPLE}", "List items take the active voice.", blocks=ITEM, word=True, yes="The file is deleted", no="Delete the file"),
    Rule("list_punctuation", "comma", ",$", "No comma after a list item.", "low", blocks=ITEM, yes="a red lamp,", no="a red lamp"),
    Rule("list_punctuation", "semicolon", ";$", "No semicolon after a list item.", "low", blocks=ITEM, yes="a red lamp;", no="a red lamp"),
    Rule("lists", "lower_case", "^[a-z][a-z]+ ", "A list item starts with a capital.", "low", blocks=ITEM, yes="open the lid", no="Open the lid"),
    Rule("lists", "these_intro", "(?i)(?:do|follow|complete|perform) these[^.]{0,40}:$", "Name what follows.", "low", yes="Complete these steps:", no="Complete the steps."),
    Rule("messages", "exaggerated", "(?i)(?:fatal|catastrophic|illegal|disastrous|abort(?:ed)?|terminated abnormally)", "The word alarms without help.", word=True, lacks=CODE, yes="A fatal error came.", no="An error came."),
    Rule("messages", "casual", "(?i)(?:oops|whoops|uh-oh|sorry|yikes|hooray|bummer)", "Too casual for a message.", "low", word=True, lacks=CODE, yes="Oops, it failed.", no="It failed."),
    Rule("messages", "please", "(?i)please ", "Messages need no please.", "low", lacks=CODE, yes="Please retry.", no="Retry."),
    Rule("messages", "blaming", "(?i)you (?:failed|forgot|entered an invalid|made a mistake|did not)", "Do not blame the reader.", word=True, lacks=CODE, yes="You forgot the key.", no="The key is missing."),
    Rule("messages", "success", "(?i)successfully", "Success goes without saying.", "low", word=True, lacks=CODE, yes="It was successfully saved.", no="It was saved."),
    Rule("messages", "preamble", "^(?i)(?:error|warning|info|notice|message): ", "The label repeats the message's kind.", "low", yes="Error: no disk.", no="No disk."),
    Rule("notes", "missing_colon", "^(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION|Note|Tip|Important|Warning|Caution) [A-Z]", "A colon goes after the label.", yes="NOTE Save first.", no="NOTE: Save first."),
    Rule("notes", "recommendation", "^(?i)recommendations?:? ", "Use a tip.", yes="Recommendation: save first.", no="TIP: save first."),
    Rule("procedures", "then", "[a-z] then ", "A comma and and go before then.", "low", blocks=("list_item_ordered",), lacks=", and then ", yes="Open it then close it.", no="Open it, and then close it."),
    Rule("procedures", "please", "(?i)please ", "A step needs no please.", "low", blocks=("list_item_ordered",), yes="Please open it.", no="Open it."),
    Rule("procedures", "imperative", "^(?:The|A|An|This|You|It|There) ", "A step starts with a verb.", blocks=("list_item_ordered",), yes="The lid opens.", no="Open the lid."),
    Rule("self_referential_text", "self", "(?i)this (?:document|section|chapter|topic|guide|manual|article|page)", "The text talks of itself.", "low", word=True, yes="This section explains it.", no="Limits explain it."),
    Rule("self_referential_text", "above_below", "(?i)(?:described|shown|listed|mentioned|see|the) (?:above|below)", "Name the place.", "low", word=True, lacks="(?i)(?:above|below) (?:zero|average|the threshold|[0-9])", yes="As described above, stop.", no="It is above zero."),
    Rule("self_referential_text", "as_follows", "(?i)as follows", "Name what follows.", "low", word=True, yes="It is as follows.", no="It is red."),
    Rule("self_referential_text", "step", "(?i)(?:previous|next|preceding|following) (?:step|section|chapter|topic)", "Name the step.", word=True, yes="Repeat the previous step.", no="Repeat step 2."),
    # technical elements
    Rule("technical_code_examples", "fragment", "^(?i)(?:for )?example:", "Say what the example shows.", "low", yes="Example: a file.", no="This example shows a file."),
    Rule("technical_code_examples", "bare_intro", "(?i)(?:the )?following example:$", "Say what the example shows.", yes="See the following example:", no="The following example opens it:"),
    Rule("technical_command_line_entry", "verb", "(?i)(?:input|key in|put in|feed) the (?:command|following command|text|value)", "type or enter.", "low", yes="Key in the command now.", no="Enter the command now."),
    Rule("technical_command_line_entry", "prompt", "(?i)command prompt", "terminal, but on Windows.", "low", word=True, lacks="(?i)windows", yes="Open a command prompt.", no="On Windows, open a command prompt."),
    Rule("technical_command_syntax", "no_noun", "(?i)(?:run|use|issue|execute) (?:ls|cp|mv|grep|sed|awk|tar|ssh|curl|chmod|git)", "Say the ls command.", "low", word=True, lacks=" command", yes="Then run tar now.", no="Then run the tar command."),
    Rule("technical_command_syntax", "variable", "<[a-z]+(?: [a-z]+)+>", "Join the variable's words.", "low", yes="Use <file name> here.", no="Use <file_name> here."),
    Rule("technical_commands", "caps_verb", "(?:to|and|then|must|can) (?:GREP|TAR|CHMOD|MOUNT|PING|CURL|SSH)", "A command is no verb.", word=True, yes="You must PING it.", no="Use the ping command."),
    Rule("technical_files_directories", "extension", "(?i)(?:an?|the|your) \\.?(?:pdf|csv|xml|json|yaml|txt|zip)s?", "Add the noun: a PDF file.", "low", word=True, lacks="(?i)(?:pdf|csv|xml|json|yaml|txt|zip) (?:file|document|format)", yes="Open the .csv now.", no="Open the CSV file now."),
    Rule("technical_files_directories", "article", "(?i)an \\.(?:pdf|csv|json|zip|py|txt)", "a, before this extension.", "low", yes="Make an .csv file.", no="Make a .csv file."),
    Rule("technical_files_directories", "noun_first", "(?i)the (?:file|directory|folder) [a-z0-9_]+\\.[a-z]{2,4}", "Name first: the x.py file.", "low", yes="Open the file main.py now.", no="Open the main.py file."),
    Rule("technical_keyboard_keys", "lower", "(?i:press) (?:enter|ctrl|alt|shift|tab|esc|delete|backspace|home|end)", "Key names take a capital.", word=True, yes="Then press enter.", no="Then press Enter."),
    Rule("technical_keyboard_keys", "combo", "(?:Ctrl|Alt|Shift|Cmd) \\+ (?:[A-Z]|Alt|Shift|Del)", "No spaces in a key combination.", "low", yes="Press Ctrl + C now.", no="Press Ctrl+C now."),
    Rule("technical_menus_navigation", "choice", "(?i)menu (?:choice|option|selection)", "menu item.", "low", word=True, yes="Pick the menu option.", no="Pick the menu item."),
    Rule("technical_menus_navigation", "ellipsis", "[A-Z][a-z]+(?:\\.\\.\\.|…) (?:button|menu|option)", "Leave the label's dots out.", "low", yes="Click the Save... button.", no="Click the Save button."),
    Rule("technical_menus_navigation", "separator", "[A-Z][a-z]+ ?(?:->|=>|/) ?[A-Z][a-z]+", "Use > between menu levels.", "low", lacks="https?://|TCP/IP", yes="Open File -> Save now.", no="Open File > Save now."),
    Rule("technical_mouse_buttons", "click_on", "(?i)(?:click|double-click|right-click) on", "click, without on.", "low", word=True, yes="Click on Save.", no="Click Save."),
    Rule("technical_mouse_buttons", "select_tab", "(?i)select the [A-Za-z]+ tab", "click the tab.", "low", yes="Select the View tab.", no="Click the View tab."),
    Rule("technical_mouse_buttons", "press_button", "(?i)(?:press|hit) the [A-Za-z]+ button", "click the button.", lacks="(?i)(?:power|reset|physical|mouse) button", yes="Press the Save button.", no="Press the power button."),
    Rule("technical_programming_elements", "verb", "(?:to|can|must|then) (?:SELECT|INSERT|UPDATE|DELETE|DROP|COMMIT|JOIN) ", "A keyword is no verb.", yes="You can SELECT the rows.", no="Use a SELECT statement."),
    Rule("technical_programming_elements", "suffix", "(?:SELECT|INSERT|UPDATE|DELETE|DROP|COMMIT|JOIN)(?:ed|ing|s)", "A keyword takes no ending.", word=True, yes="It SELECTs rows.", no="It selects rows."),
    Rule("technical_ui_elements", "appears", "(?i)(?:window|dialog|box|page|screen|message) (?:appears|displays|pops up)", "opens, or is displayed.", "low", word=True, yes="A window appears now.", no="A window opens now."),
    Rule("technical_ui_elements", "food", "(?i)(?:hamburger|kebab|meatball|breadcrumb) (?:menu|icon|button)", "Name the menu.", word=True, yes="Open the kebab menu.", no="Open the main menu."),
    Rule("technical_ui_elements", "checkbox", "(?i)(?:click|check|tick) the [A-Za-z ]{0,20}check ?box", "select the checkbox.", "low", yes="Tick the Auto checkbox.", no="Select the Auto checkbox."),
    Rule("technical_ui_elements", "button", "(?i)select the [A-Za-z]+ button", "click the button.", "low", yes="Select the Save button.", no="Click the Save button."),
    Rule("technical_web_addresses", "bare_www", "www\\.[a-z0-9.-]+", "Write the protocol.", "low", before="/A-Za-z", yes="See www.example.com now.", no="See https://www.example.com now."),
    Rule("technical_web_addresses", "protocol", "(?:HTTPS?|FTP|Https?)://[^ ]+", "The protocol is lower case.", yes="See HTTP://a.org now.", no="See http://a.org now."),
    Rule("technical_web_addresses", "slash", "https?://[^ /]+/", "No slash at the end.", "low", after="A-Za-z0-9_?#%~.-", yes="See http://a.org/ now.", no="See http://a.org/b now."),
    # word usage by pattern
    Rule("word_usage_pattern", "login", "(?i)(?:to|can|must|please) (?:login|setup|backup|logon|shutdown|startup)", "The verb is two words.", word=True, status="dormant", yes="You can login now.", no="You can log in now."),
    Rule("word_usage_special", "sign", "(?i)(?:w/o?|b/c|@ (?:the|a)|24x7|#[0-9]+)", "Write the word.", before="A-Za-z0-9/", status="dormant", yes="Coffee w/o milk.", no="Coffee without milk."),
    Rule("case_sensitive_terms", "case", "(?:Json|Xml|Html|Yaml|Sql|Url|Api|Http|Ssh|Cpu|Usb|Id|wifi|Wifi|bluetooth|Iot)", "The term is written otherwise.", word=True, lacks=CODE, status="dormant", yes="Send Json to it.", no="Send JSON to it."),
    Rule("product_names", "case", "(?:kubernetes|openshift|ansible|Mariadb|apache kafka|hadoop|Rest API|tensorflow|pytorch)", "The product is written otherwise.", word=True, lacks=CODE, status="dormant", yes="Install ansible on it.", no="Install Ansible on it."),
    Rule("glossaries", "capital", "^[A-Z][a-z]+(?:[:—]| - )", "A glossary term is lower case.", blocks=("dlist",), status="dormant", yes="Widget: a part.", no="widget: a part."),
)

#: Directory names whose occurrence in a rule's name gives its category, and the categories; else style.
CATEGORIES = (("word_usage", "word-usage"), ("references", "references"), ("punctuation", "punctuation"), ("structure_and_format", "structure"), ("numbers_and_measurement", "numbers"), ("technical_elements", "technical"), ("legal_information", "legal"), ("language_and_grammar", "grammar"), ("audience_and_medium", "audience"), ("modular_compliance", "modular-compliance"))


def category(rule_type: str) -> str:
    return next((c for name, c in CATEGORIES if name in rule_type), "style")


#: Rules of signs and addresses, which hold in any language; all others are about English.
ANY_LANGUAGE = frozenset(("colons", "dashes", "ellipses", "exclamation_points", "parentheses", "punctuation_and_symbols", "semicolons", "slashes", "spacing", "highlighting", "indentation", "technical_web_addresses"))


def english(rule: Rule) -> bool:
    """Whether a rule is about English alone."""
    return rule.rule_type not in ANY_LANGUAGE


RULE_TYPES = tuple(dict.fromkeys(r.rule_type for r in RULES))
