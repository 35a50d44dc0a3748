"""Own specimens of whole documents, with negative ids: structures and wordings that the tables lack.

`blocks` queries read STRUCTURES beside the pages, `text` queries read PROSE beside the documents.
"""

from __future__ import annotations

H, P, O, U, A, L, I = "heading", "paragraph", "list_item_ordered", "list_item_unordered", "admonition", "listing", "image"  # noqa: E741

#: (block type, level, content) of each document.
STRUCTURES = {
    # A procedure in order, with too many steps, and verified.
    -1001: [(H, 1, "Installing the agent"), (P, 0, "You install the agent on each node."), (H, 2, "Prerequisites"), (U, 0, "A node is ready."), (H, 2, "Procedure"), *[(O, 0, f"Do step {k}.") for k in range(1, 13)], (H, 2, "Verification"), (P, 0, "Check the state.")],
    # Prerequisites after the procedure, no verification, one step alone, admonitions on top of each other.
    -1002: [(A, 0, "NOTE: Read this first."), (H, 1, "Set up a node"), (A, 0, "TIP: Plan ahead."), (P, 0, "A node runs work."), (H, 2, "Procedure"), (O, 0, "Run the command."), (H, 2, "Prerequisites"), (P, 0, "Have a node."), (A, 0, "WARNING: Do not stop."), (A, 0, "NOTE: It takes long. Wait for it. Then look. Then go on."), (A, 0, "NOTE: Be patient.")],
    # Levels skipped, an empty section, an indented paragraph, a label that is no admonition's.
    -1003: [(H, 1, "About storage"), (H, 3, "Volumes"), (H, 3, "Pools"), (P, 1, "A pool holds volumes."), (P, 0, "FYI: Pools grow."), (H, 2, "Limits"), (H, 2, "Further reading")],
    # A where list, units that differ between code and prose, terms without markup.
    -1004: [(H, 1, "Memory options"), (P, 0, "Set the limit."), (L, 0, "limit = 512 MiB"), (P, 0, "where:"), (U, 0, "`limit`: Specify the memory."), (U, 0, "`unit`: Specifies the unit."), (P, 0, "The default is 256 MB and max_mem is 1 GB."), (P, 0, "Then max_mem rules over `max_mem` and min_mem.")],
    # An assembly, nested too deep, with a long title and no introduction.
    -1005: [(H, 1, "A guide to everything that one may wish to know about the storage of large volumes of data"), (H, 2, "One"), (H, 3, "Two"), (H, 4, "Three"), (H, 2, "Four"), (H, 2, "Five"), (H, 2, "Six")],
    # A reference with prose, and a finding that runs over a block's end.
    -1006: [(H, 1, "Options"), (P, 0, "This table lists the"), (P, 0, "the options of the tool."), ("table_cell", 0, "name"), ("table_cell", 0, "value"), ("dlist", 0, "The size.")],
    # The same title as another module, of another type.
    -1007: [(H, 1, "Memory options"), (P, 0, "Memory has options."), (O, 0, "Choose one."), (O, 0, "Set it.")],
}

PROSE = {
    -2001: "The Application Programming Interface (API) is used daily. A Central Processing Unit (CPU) runs it. The CPU is fast. GPU cards are not (GPU) Graphics Processing Unit cards.",
    -2002: "The TLA is never told. Its GUI shows the API. They keep the Graphical User Interface (GUI) simple. The Great Unified Index (GUI) is another one.",
    -2004: "Holland is a small country. The kingdom that once was known to many people by the name of Holland ended. There are three nodes. It is a node. Here is one. America is a continent.",
    -2003: "In order to start, utilize the the tool... The colour is grey!! We leverage a lot of it, e.g. Now.",
}


def structure_rows() -> list[tuple]:
    return [(doc, k, kind, level, content) for doc, blocks in STRUCTURES.items() for k, (kind, level, content) in enumerate(blocks)]
