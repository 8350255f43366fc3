"""Which files under a source root hold dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of the file names of each format, without case.
ENDINGS = {
    "codex": (".jsonl", ".sqlite", ".sqlite3", ".db"), "claude-code": (".jsonl",), "opencode": (".db", ".json"),
    "cursor": (".vscdb", ".db", ".json"), "qwen-code": (".jsonl",), "omp": (".jsonl",),
}
# Whole file names of the format that has no endings, and folders whose files are no dialogues.
WHOLE_NAMES = {"kimi-code": ("state.json", "session_index.jsonl", "wire.jsonl")}
LEFT_OUT = {"claude-desktop": r"(^|/)skills-plugin/|/rpm/"}


def holds_dialogues(path: Column, harness: str) -> Column:
    """Whether a file, by its path under the root, belongs to a format; resource forks never do."""
    name = F.substring_index(path, "/", -1)
    if harness in ENDINGS:
        mine = F.lit(False)
        for e in ENDINGS[harness]:
            mine = mine | F.lower(name).endswith(e)
    elif harness in WHOLE_NAMES:
        mine = name.isin(*WHOLE_NAMES[harness])
    else:
        mine = ~path.rlike(LEFT_OUT[harness])
    return mine & ~name.startswith("._")


def select_files(listing: DataFrame, harness: str) -> DataFrame:
    """Rows of listing(path, ...) that belong to a format."""
    return listing.filter(holds_dialogues(F.col("path"), harness))
