"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a cheap or dear expression over one text. On a sample bounded in rows and bytes its cost (time of a job that evaluates
nothing else) and its selectivity (share it rejects of the texts that the rules before it leave) are estimated; rules then run in order of rejections per
second, and a text that one rule rejects is not shown to the next. The order never changes a verdict.

Counts are exact but for windows of three words, which are told apart by 64 bits: in a text of a million words two different ones are taken for equal with
a probability of 3e-8.

Null and empty texts have no words and are rejected (too few words). Very long texts cost n log n. Repeated rows get
equal verdicts. An empty table gives an empty result. Extra columns stay; columns named like a result are replaced."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.session import dropped, written

#: Estimation looks at no more rows and bytes than these; it settles the order of rules, never a verdict.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 4 << 20
#: Times that the sample is gone through in one timed job.
REPEATS = 5
#: A column that is made and taken apart within judged().
MADE = "rules: made of the text"
SYMBOLS = "#*$%&|<>"


def _words(t: str) -> str:
    """SQL for the words of a text. A split at one plain character is several times as fast as one at a pattern."""
    for c in ("\\t", "\\n", "\\u000b", "\\f", "\\r"):
        t = f"replace({t}, '{c if c != chr(92) + 'f' else chr(92) + 'u000c'}', ' ')"
    return f"array_remove(split({t}, ' '), '')"


def _repeat_words() -> str:
    """SQL for the words that lie in a 3-word window found twice or more in the text.

    Windows are hashed (64 bits); if all differ, nothing repeats. Else pairs of a whole hash and its position are sorted;
    windows whose hash equals a neighbour's repeat, and the union of [p, p + 3) over their positions is counted.
    aggregate() over an array of one element stands for a local name."""
    union = "aggregate(sort_array({p}), struct(0L AS n, -9L AS last), (a, p) -> struct(a.n + least(3L, p - a.last) AS n, p AS last), a -> a.n)"
    near = "CASE WHEN i > 0 AND s[greatest(i - 1, 0)].h = x.h THEN true WHEN i + 1 < size(s) THEN s[least(i + 1, size(s) - 1)].h = x.h ELSE false END"
    pairs = "sort_array(transform(h, (x, i) -> struct(x AS h, CAST(i AS BIGINT) AS p)))"
    found = f"aggregate(array({pairs}), 0L, (v, s) -> " + union.format(p=f"transform(filter(s, (x, i) -> {near}), x -> x.p)") + ")"
    windows = "slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, size(w) - 2)"
    return f"CASE WHEN size(w) < 4 THEN 0L ELSE aggregate(array({windows}), 0L, (q, h) -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {found} END) END"


_LINES = "filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
_SIZE = "CAST(length(t) - length({x}) AS BIGINT)"
#: SQL for each metric, over the text t (never null) and the array w of its words.
METRICS = {
    "n_words": "CAST(size(w) AS BIGINT)",
    "word_chars": "CAST(length(array_join(w, '')) AS BIGINT)",
    "n_symbols": _SIZE.format(x=f"regexp_replace(t, '[{SYMBOLS}]+', '')"),
    "n_dup_lines": f"CASE WHEN size(array_distinct(split(t, '\\n'))) = size(split(t, '\\n')) THEN 0L ELSE aggregate(array({_LINES}), 0L, (z, y) -> CAST(size(y) - size(array_distinct(y)) AS BIGINT)) END",
    "n_repeat_words": _repeat_words(),
    # those of the cascade alone
    "n_marks": _SIZE.format(x="replace(t, '!', '')"),
    "n_letters": _SIZE.format(x="regexp_replace(t, '\\\\p{L}+', '')"),
    "n_capitals": _SIZE.format(x="regexp_replace(t, '\\\\p{Lu}+', '')"),
    "n_digits": _SIZE.format(x="regexp_replace(t, '[0-9]+', '')"),
    "longest_word": "CAST(coalesce(array_max(transform(w, x -> length(x))), 0) AS BIGINT)",
    "n_lines": f"CAST(size({_LINES}) AS BIGINT)",
    "n_bullets": f"CAST(size(filter(split(t, '\\n'), x -> x rlike '^[\\\\x20\\\\x09]*[-*\u2022]')) AS BIGINT)",
    "n_ellipses": "CAST(size(filter(split(t, '\\n'), x -> x rlike '([.][.][.]|\u2026)[\\\\x20\\\\x09\\\\x0D]*$')) AS BIGINT)",
}
#: The metrics that op8's contract returns for every text.
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: SQL that holds for texts that fail, over the names of metrics in braces."""

    name: str
    rejects: str

    @property
    def metrics(self) -> set[str]:
        return {m for _, m, _, _ in Formatter().parse(self.rejects) if m}


#: Thresholds of production. Ratios are kept in integers, so that every engine agrees on them.
BASE = (Rule("too_few_words", "{n_words} < 50"), Rule("repeated_words", "100 * {n_repeat_words} > 50 * {n_words}"))
RULES = (
    Rule("word_length", "({word_chars} < 2 * {n_words} OR {word_chars} > 15 * {n_words})"),
    Rule("symbols", "10 * {n_symbols} > {n_words}"),
    Rule("repeated_lines", "({n_dup_lines} >= 3 AND 20 * {n_dup_lines} > {n_words})"),
    Rule("shouting", "5 * {n_marks} > {n_words}"),
    Rule("few_letters", "2 * {n_letters} < {word_chars}"),
    Rule("capitals", "2 * {n_capitals} > {n_letters}"),
    Rule("digits", "5 * {n_digits} > {word_chars}"),
    Rule("long_word", "{longest_word} > 1000"),
    Rule("bullets", "10 * {n_bullets} > 9 * {n_lines}"),
    Rule("ellipses", "10 * {n_ellipses} > 3 * {n_lines}"),
)


def over_words(text: str, body: str) -> Column:
    """The SQL body, in which t is the text (empty if null) and w the array of its words, made once."""
    t = f"coalesce(`{text}`, '')"
    return F.expr(f"element_at(transform(array(struct({t} AS t, {_words(t)} AS w)), o -> element_at(transform(array(o.t), t -> element_at(transform(array(o.w), w -> {body}), 1)), 1)), 1)")


def n_words(text: str = "text") -> Column:
    return F.size(F.expr(_words(f"coalesce(`{text}`, '')"))).cast("long")


def bounded_sample(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[str]:
    """Texts for the estimates, on the driver: those of the first rows of a scan, no more than the bytes allow.

    Spark takes so many rows, a partition at a time until it has them; texts over a hundredth of the bytes are left out there, so what is collected is bounded too."""
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0))
    got = df.where(size <= most // 100).select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).take(rows)
    out, total = [], 0
    for r in got:
        total += len(r.text.encode("utf-8", "replace"))
        if total > most:
            break
        out.append(r.text)
    return out


def measured(df: DataFrame, rules: tuple[Rule, ...], text: str = "text", repeats: int = REPEATS) -> tuple[list[list[bool]], list[float]]:
    """For each rule: what it rejects of the sample, and its seconds a text.

    A rule is timed in a job of one task over the sample many times, after a warm-up run, as the least of several runs less that of a job that
    only reads the texts. Costs are rounded to powers of two of a microsecond, so that noise seldom changes the order."""
    spark, texts = df.sparkSession, bounded_sample(df, text)
    if not texts:
        return [[] for _ in rules], [1e-6 for _ in rules]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    failed = [over_words("text", r.rejects.format(**METRICS)) for r in rules]
    verdicts = rows.select("i", *[f.alias(f"r{k}") for k, f in enumerate(failed)]).orderBy("i").collect()
    many = written(rows.select(F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("n"), "text").coalesce(1), "rule-sample").coalesce(1)

    def seconds(c: Column) -> float:
        best = []
        for _ in range(4):
            began = time.perf_counter()
            many.agg(F.count_if(c)).first()
            best.append(time.perf_counter() - began)
        return min(best[1:])

    nothing = seconds(over_words("text", "length(t) < 0"))
    costs = [max(seconds(f) - nothing, 0.0) / (repeats * len(texts)) for f in failed]
    dropped(many)
    return [[bool(v[f"r{k}"]) for v in verdicts] for k in range(len(rules))], [2.0 ** round(math.log2(max(c, 1e-6) / 1e-6)) * 1e-6 for c in costs]


def estimated_order(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> list[dict]:
    """Rules in the order of the cascade, from the sample: each next one is that with the most rejections per cost among the texts that
    the ones before leave; ties by name."""
    rejected, costs = measured(df, rules, text)
    left, order = set(range(len(rejected[0]) if rejected else 0)), []
    open_ = set(range(len(rules)))
    while open_:
        share = {k: sum(rejected[k][i] for i in left) / len(left) if left else 0.0 for k in open_}
        k = min(open_, key=lambda k: (-share[k] / costs[k], rules[k].name))
        order.append({"rule": rules[k], "cost": costs[k], "share": share[k], "rank": share[k] / costs[k]})
        left -= {i for i in left if rejected[k][i]}
        open_.remove(k)
    return order


def judged(df: DataFrame, order: list[dict], text: str = "text", names: tuple[str, ...] = CONTRACT, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """df with a long column for each named metric, and failed_rule: the first rule that rejects the text, the base ones before those of the order; null if none does.

    Rules are branches of one CASE, so a text that a rule rejects is not shown to the next, and metrics that aren't among the names are made inside their branches."""
    value = {m: f"m.{m}" if m in names else sql for m, sql in METRICS.items()}
    case = " ".join(f"WHEN {r.rejects.format(**value)} THEN '{r.name}'" for r in [*base, *[x["rule"] for x in order]])
    made = f"struct({', '.join(f'{METRICS[m]} AS {m}' for m in names)})" if names else "struct(0 AS none)"
    body = f"element_at(transform(array({made}), m -> struct({''.join(f'm.{m} AS {m}, ' for m in names)}CASE {case} END AS failed_rule)), 1)"
    replaced = {*names, "failed_rule"}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in replaced]
    return df.select(*kept, over_words(text, body).alias(MADE)).select(*kept, *[f"`{MADE}`.{m}" for m in (*names, "failed_rule")])


def verdict(order: list[dict], text: str = "text") -> Column:
    """The name of the first rule, in that order, that rejects the text; null if none does. Lazy in the same way."""
    return over_words(text, "CASE " + " ".join(f"WHEN {x['rule'].rejects.format(**METRICS)} THEN '{x['rule'].name}'" for x in order) + " END")


def filtered(df: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of df."""
    return df.where(verdict(estimated_order(df, rules, text), text).isNull())
