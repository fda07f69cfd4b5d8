"""Quality rules: a threshold table compiled into one projection.

Every metric is a Spark SQL expression over ``text``; every rule is a row (name, expression, least, most).
The table becomes one ``select`` without user functions, joins or shuffles, so it runs at scan speed and
inside the reader's stage.

Defined results: a null or empty text has zero words and is rejected by ``few_words``; ratios over nothing
are 0; repeated rows are judged one by one; an empty table gives an empty result; any columns but the id
and the text are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is that it for was on are with as be at by this from or an "
            "de la le les des et en un une du que qui dans pour est il au ce pas sur avec par "
            "der die das und den von zu mit ein eine ist nicht im auf für sich dem des auch als "
            "el los las del se y por con no su una para es al lo como más".split()
        )
    )
)


class Rule(NamedTuple):
    """Rejects a document whose metric lies outside [least, most]; texts of fewer than ``from_words`` words are exempt."""

    name: str
    metric: str
    least: float | None
    most: float | None
    from_words: int = 0


#: Counts that the rules are written over; each is evaluated once.
COUNTS = {
    "n_chars": "length(t)",
    "n_words": "size(words)",
    "n_word_chars": "length(t) - n_spaces",
    "n_symbols": "length(regexp_replace(t, '[^#$%&*|<>{}\\\\[\\\\]^~=_+\\\\\\\\/@]+', ''))",
    "n_upper": "length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', ''))",
    "n_exclaim": "length(t) - length(replace(t, '!', ''))",
    "n_repeats": "size(filter(words, (w, i) -> i > 0 AND w = get(words, i - 1)))",
    "n_stop": "size(filter(words, w -> w IN (%s)))" % ", ".join(f"'{w}'" for w in STOP_WORDS),
    "n_lines": "size(lines)",
    "n_distinct_lines": "size(array_distinct(lines))",
    "n_ellipsis": "size(filter(lines, l -> l LIKE '%...' OR l LIKE '%…'))",
    "n_bullets": "size(filter(lines, l -> substring(l, 1, 2) IN ('- ', '* ', '• ', '+ ')))",
}
RULES = (
    Rule("few_words", "n_words", 1, None),
    Rule("word_length", "n_word_chars / n_words", 1.5, 15, 20),
    Rule("symbols", "n_symbols / n_chars", None, 0.05, 10),
    Rule("capitals", "n_upper / n_word_chars", None, 0.5, 20),
    Rule("exclamations", "n_exclaim / n_words", None, 0.5, 20),
    Rule("repeated_words", "n_repeats / n_words", None, 0.2, 20),
    Rule("stop_words", "n_stop / n_words", 0.02, None, 50),
    Rule("repeated_lines", "n_distinct_lines / n_lines", 0.5, None, 50),
    Rule("ellipsis_lines", "n_ellipsis / n_lines", None, 0.3, 20),
    Rule("bullet_lines", "n_bullets / n_lines", None, 0.9, 20),
)


def _broken(r: Rule) -> str:
    over, _, under = r.metric.partition(" / ")
    metric = f"coalesce({over} / nullif({under}, 0), 0)" if under else over
    bounds = [f"{metric} {op} {bound!r}D" for op, bound in (("<", r.least), (">", r.most)) if bound is not None]
    test = f"({' OR '.join(bounds)})"
    return f"(n_words >= {r.from_words} AND {test})" if r.from_words else test


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None) -> DataFrame:
    """The id, the counts of COUNTS and whatever columns are named in ``also`` (under their names)."""
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"_also_{i}") for i, c in enumerate(also or [])], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = base.selectExpr("*", "filter(split(lower(t), '[ \\\\t\\\\r\\\\n]+'), w -> w <> '') AS words", "filter(split(t, '[\\\\r\\\\n]+'), l -> l <> '') AS lines", "length(regexp_replace(t, '[^ \\\\t\\\\r\\\\n]+', '')) AS n_spaces")
    # a generator of one row: filters on the counts stay above it, so that the counts aren't worked out again for each use in a filter
    counts = ", ".join(f"'{n}', CAST({e} AS BIGINT)" for n, e in COUNTS.items())
    return split.selectExpr("doc_id", *[f"`_also_{i}`" for i in range(len(also or []))], f"inline(array(named_struct({counts})))")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, also: list[str] | None = None) -> DataFrame:
    """(doc_id, counts, failed, keep): ``failed`` names the broken rules, in the table's order, parted by commas."""
    out = metrics(docs, id_col, text_col, also)
    failed = "concat_ws(',', %s)" % ", ".join(f"CASE WHEN {_broken(r)} THEN '{r.name}' END" for r in rules)
    out = out.selectExpr("*", f"{failed} AS failed").withColumn("keep", F.col("failed") == "")
    return out


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with all their columns."""
    cols = docs.columns
    out = judge(docs, id_col, text_col, rules, also=cols).filter("keep")
    return out.select(*[F.col(f"_also_{i}").alias(c) for i, c in enumerate(cols)])


def oracle() -> str:
    """The same table as DuckDB SQL over ``documents``."""
    counts = {
        "n_chars": "length(t)",
        "n_words": "len(words)",
        "n_word_chars": "length(t) - n_spaces",
        "n_symbols": "length(regexp_replace(t, '[^#$%&*|<>{}\\[\\]^~=_+\\\\/@]+', '', 'g'))",
        "n_upper": "length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g'))",
        "n_exclaim": "length(t) - length(replace(t, '!', ''))",
        "n_repeats": "len(list_filter(words, lambda w, i: i > 1 AND w = words[i - 1]))",
        "n_stop": "len(list_filter(words, lambda w: w IN (%s)))" % ", ".join(f"'{w}'" for w in STOP_WORDS),
        "n_lines": "len(lines)",
        "n_distinct_lines": "len(list_distinct(lines))",
        "n_ellipsis": "len(list_filter(lines, lambda l: l LIKE '%...' OR l LIKE '%…'))",
        "n_bullets": "len(list_filter(lines, lambda l: l[1:2] IN ('- ', '* ', '• ', '+ ')))",
    }
    failed = "concat_ws(',', %s)" % ", ".join(f"CASE WHEN {_broken(r).replace('D)', ')').replace('D OR', ' OR')} THEN '{r.name}' END" for r in RULES)
    return (
        "WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
        "w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[ \\t\\r\\n]+'), lambda w: w <> '') AS words, list_filter(regexp_split_to_array(t, '[\\r\\n]+'), lambda l: l <> '') AS lines, length(regexp_replace(t, '[^ \\t\\r\\n]+', '', 'g')) AS n_spaces FROM s), "
        f"c AS (SELECT doc_id, {', '.join(f'CAST({e} AS BIGINT) AS {n}' for n, e in counts.items())} FROM w), "
        f"f AS (SELECT *, {failed} AS failed FROM c) SELECT *, failed = '' AS keep FROM f"
    )
