"""Names and types of the data model."""

CONTENT_TYPES = ("concept", "procedure", "reference", "assembly", "release_notes")
SEVERITIES = ("high", "medium", "low")
STATUSES = ("open", "accepted", "dismissed", "resolved")
FILE_TYPES = ("asciidoc", "markdown", "html", "xml", "dita", "docx", "pdf", "plaintext")
SOURCES = ("deterministic", "languagetool", "llm")

BLOCK = "doc_id long, block_idx int, parent_idx int, block_type string, level int, content string, raw_content string, start_pos int, end_pos int, skip boolean"
ISSUE = "doc_id long, ord int, source string, category string, rule_name string, flagged_text string, message string, suggestions array<string>, severity string, sentence string, sentence_index int, start int, `end` int, citation string, confidence double, status string"

#: Block types that no rule reads.
CODE_LIKE = ("listing", "literal", "code", "pass", "comment", "attribute")
