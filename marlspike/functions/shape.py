"""Question shape and named entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlspike.functions import text as T

# The patterns of each shape, in the order of their check, and what each shape is answered with.
PROHIBITION = (
    r"\bcan\s+(?:i|you|we|they|a\s+player|my\s+\w+|the\s+\w+)\b",
    r"\b(?:am|are|is)\s+(?:i|you|we|they|it|a\s+player)\s+(?:allowed|permitted|able)\b",
    r"\bis\s+it\s+(?:legal|allowed|permitted|okay|ok|valid)\b",
    r"\bcould\s+(?:i|you|we|a\s+player)\b",
    r"\bmay\s+(?:i|you|we|they|a\s+player)\b",
    r"\b(?:do|does|did)\s+(?:i|you|we|they|a\s+player)\s+(?:have\s+to|need\s+to|get\s+to)\b",
    r"\b(?:anything|something|any\s+rule|any\s+way)\s+(?:that\s+)?(?:stop|prevent|forbid|block|prohibit)",
    r"\bwhat\s+(?:stops|prevents|forbids)\b",
    r"\bam\s+i\s+(?:supposed|meant)\s+to\b",
    r"\bhave\s+to\b.*\?",
    r"\bwithout\s+\w+ing\b.*\?",
    r"\b(?:illegal|disallowed|forbidden|banned)\b",
    r"\bstack(?:s|ed|ing)?\s+with\b",
    r"\bat\s+the\s+same\s+time\b",
    r"\b(?:instead\s+of|rather\s+than)\b.*\?",
    r"\b(?:someone\s+else|another\s+player|an?\s*opponent|opponent)(?:'s|s')\s+turn\b",
    r"\b(?:during|on|outside\s+of)\s+(?:my|your|their|his|her|the)\s+\w*\s*turn\b",
    r"\bout\s+of\s+turn\b",
    r"\bbefore\s+(?:i|you|we|they)\s+\w+",
    r"\bafter\s+(?:i|you|we|they)(?:'ve|\s+have)?\s+already\b",
)
HOW_TO_PLAY = (
    r"\bhow\s+(?:do\s+(?:i|you|we)\s+)?play\b",
    r"\bhow\s+does\s+(?:this|the)\s+game\s+work\b",
    r"\bhow\s+do\s+(?:i|you|we)\s+(?:start|begin|set\s*up)\b",
    r"\b(?:teach|explain)\s+(?:me\s+)?(?:the\s+)?(?:game|rules|basics)\b",
    r"\bwhat(?:'s|\s+is)\s+the\s+(?:goal|objective|point)\b",
    r"\bfirst\s+time\s+(?:playing|player)\b",
)
EFFORT = {"prohibition": "medium", "lookup": "low", "how_to_play": "low"}
#: k, per arm, whole sections, least number of rules.
OPTIONS = {"prohibition": (10, 40, True, 4), "lookup": (8, 40, False, 2), "how_to_play": (8, 40, False, 2)}


def any_of(patterns: tuple[str, ...], edge: str = r"\b") -> str:
    """All patterns as one alternation, read once."""
    return "(?i)" + "|".join(f"(?:{p.replace(chr(92) + 'b', edge)})" for p in patterns)


#: A word edge between ASCII word characters and all others, as the patterns mean it.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def shape(question: Column) -> Column:
    """prohibition before how_to_play, else lookup."""
    q = T.trim(question)
    return F.when(q.rlike(any_of(PROHIBITION, EDGE)), "prohibition").when(q.rlike(any_of(HOW_TO_PLAY, EDGE)), "how_to_play").otherwise("lookup")


def effort(shape_: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in EFFORT.items() for x in kv)), shape_)


def option(shape_: Column, i: int) -> Column:
    """One of k (0), per arm (1), whole sections (2), rules (3) by shape."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in OPTIONS.items() for x in (k, v[i]))), shape_)


def entities(question: Column) -> Column:
    """Quoted spans of 2 to 40 characters, then runs of capitalised words but for the first word; distinct, in order.

    A run ends at the first word that isn't capitalised; marks at a word's end don't matter.
    """
    pattern = "\"([^\"]{2,40})\"|'([^']{2,40})'"
    quoted = F.transform(F.regexp_extract_all(question, F.lit(pattern), F.lit(0)), lambda q: T.trim(F.substring(q, F.lit(2), F.length(q) - 2)))
    bare = F.transform(F.split(question, r"\s+"), lambda w, i: F.struct(i.alias("i"), F.regexp_replace(w, "[^A-Za-z'-]", "").alias("w")))
    caps = F.transform(bare, lambda x: F.when((x.i > 0) & x.w.rlike("^[A-Z][a-z'-]+$"), x.w).otherwise(""))
    runs = F.aggregate(
        caps,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run")),
        lambda s, w: F.struct(
            F.when((w == "") & (s.run != ""), F.concat(s.out, F.array(s.run))).otherwise(s.out).alias("out"),
            F.when(w == "", "").when(s.run == "", w).otherwise(F.concat(s.run, F.lit(" "), w)).alias("run"),
        ),
        lambda s: F.when(s.run != "", F.concat(s.out, F.array(s.run))).otherwise(s.out),
    )
    return F.filter(F.array_distinct(F.concat(quoted, runs)), lambda e: F.length(e) > 1)
