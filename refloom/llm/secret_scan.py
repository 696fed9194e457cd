"""Secret scanning by a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: a match must
contain all trigrams of one of the query's conjunctions. The index lists, for each of the two rarest
trigrams of a conjunction, the texts that contain it (in lower case, so that
one index serves rules of either case). Postings are intersected by counting the
trigrams of each conjunction per text; candidates are then verified by the regex itself. A
rule whose query is empty (no trigram is mandatory) scans every text. Equal texts are one entry.

All of it is DataFrame expressions. Offsets come from the lengths of matches and of
the pieces between them, summed up per text and rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import one_of_each, stage, text_key
from refloom.llm.regex import Chars, Either, parse


@dataclass(frozen=True)
class Rule:
    """regex: valid in Python and Java. Of its matches (leftmost, not overlapping) those count whose
    measured group (0: all) has at least least characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The first three are the base rules, in their order; the others are well-known public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # maximal runs, so the same matches as [0-9a-f]+ of 24 or more
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

_SET_LIMIT = 16


def _grams(strings: set[str]) -> list[frozenset[str]] | None:
    """A conjunction of trigrams for each string; None if some string is too short to need one."""
    if any(len(s) < 3 for s in strings):
        return None
    return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]


def _conjoin(a: list[frozenset[str]] | None, b: list[frozenset[str]] | None) -> list[frozenset[str]] | None:
    """Both queries (None: no demand). A product that grows too large keeps the more selective side."""
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > 4 * _SET_LIMIT:
        return max(a, b, key=lambda q: min(map(len, q)))
    return [x | y for x in a for y in b]


def _analyse(nodes: tuple) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """(all strings that the sequence can match, or None if too many; its trigram query, or None)."""
    run: set[str] = {""}
    query, whole = None, True
    for node in nodes:
        strings, inner = _of(node)
        if strings is not None and len(run) * len(strings) <= _SET_LIMIT:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _conjoin(query, _grams(run)), False
        run = {""} if strings is None else strings
        query = query if strings is not None else _conjoin(query, inner)
    return (run, None) if whole else (None, _conjoin(query, _grams(run)))


def _of(node) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """The same of one node."""
    if isinstance(node, Chars):
        some = None if node.some is None else {c.lower() for c in node.some}
        return (None if some is None or len(some) > _SET_LIMIT else some), None
    if isinstance(node, Either):
        parts = [_analyse(way) for way in node.ways]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= _SET_LIMIT:
            return set().union(*(s for s, _ in parts)), None
        queries = [q if s is None else _conjoin(q, _grams(s)) for s, q in parts]
        return None, None if any(q is None for q in queries) else [x for q in queries for x in q]
    strings, inner = _of(node.node)
    if (node.low, node.high) == (0, 1) and strings is not None and len(strings) < _SET_LIMIT:
        return strings | {""}, None
    if node.low == node.high and node.low <= 8 and strings is not None and len(strings) == 1:
        return {next(iter(strings)) * node.low}, None
    if node.low == 0:
        return None, None
    return None, inner if strings is None else _conjoin(inner, _grams(strings))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Disjunction of conjunctions of lower-case trigrams that any match contains; None if there is none."""
    strings, query = _of(parse(regex))
    query = _grams(strings) if strings is not None else query
    return None if query is None else sorted(set(query), key=sorted)


#: Letters from frequent to rare; trigrams of rare ones are looked up, as few texts have them.
_BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
#: Trigrams of a conjunction that are looked up; leaving some out only adds candidates.
LOOKED_UP = 2


def rarest(conjunction: frozenset[str], most: int = LOOKED_UP) -> list[str]:
    """The trigrams of a conjunction that texts are least likely to have; what is no letter is rarer than all letters."""
    rank = lambda c: _BY_FREQUENCY.index(c) if c in _BY_FREQUENCY else len(_BY_FREQUENCY)
    return sorted(conjunction, key=lambda g: (-sum(map(rank, g)), g))[:most]


_MATCHES = "array<struct<rule:int,i:int,gap:int,whole:int,good:boolean>>"


def _matches(n: int, r: Rule) -> F.Column:
    """Lengths of each match of a rule in text and of the gap before it; a last one without match is the rest."""
    text = F.col("text")
    whole = F.regexp_extract_all(text, F.lit(r.regex), F.lit(0))
    pairs = F.zip_with(F.split(text, r.regex, -1), whole, lambda gap, w: F.struct(F.length(gap).alias("gap"), F.length(w).alias("whole"), F.length(w).alias("size")))
    if r.group:
        measured = F.regexp_extract_all(text, F.lit(r.regex), F.lit(r.group))
        pairs = F.zip_with(pairs, measured, lambda x, m: F.struct(x["gap"].alias("gap"), x["whole"].alias("whole"), F.length(m).alias("size")))
    return F.transform(pairs, lambda x, i: F.struct(F.lit(n).alias("rule"), i.alias("i"), x["gap"].alias("gap"), x["whole"].alias("whole"), (x["size"] >= r.least).alias("good")))


def _spans(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k, rule, start, end) of each span in each different text; keyed has doc_id, text and k, its content key."""
    spark = keyed.sparkSession
    queries = [trigram_query(r.regex) for r in rules]
    terms = [(n, c, gram, 1 << b, (1 << min(len(conj), LOOKED_UP)) - 1) for n, q in enumerate(queries) if q for c, conj in enumerate(q) for b, gram in enumerate(rarest(conj))]
    vocabulary = sorted({t[2] for t in terms})
    every = []
    if vocabulary:
        low = keyed.select("k", F.lower("text").alias("low"))
        grams = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in vocabulary]))
        postings = low.select("k", F.explode(grams).alias("gram"))
        wanted = F.broadcast(spark.createDataFrame(terms, "rule int, part int, gram string, bit long, all long"))  # its size depends on the rules only
        met = postings.join(wanted, "gram").groupBy("k", "rule", "part", "all").agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") == F.col("all"))
        bit = F.element_at(F.array(*[F.lit(1 << n) for n in range(len(rules))]), F.col("rule") + 1)
        every.append(met.select("k", bit.alias("mask")))
    full = [n for n, q in enumerate(queries) if q is None]
    if full:
        scanned = sum((F.col("text").rlike(rules[n].regex).cast("int") * (1 << n) for n in full), F.lit(0))
        every.append(keyed.select("k", scanned.alias("mask")).filter("mask != 0"))
    masks = every[0] if len(every) == 1 else every[0].unionByName(every[1])
    masks = masks.groupBy("k").agg(F.bit_or("mask").alias("mask"))
    texts = one_of_each(keyed, masks).dropDuplicates(["k"])
    pieces = [F.when(F.col("mask").bitwiseAND(1 << n) != 0, _matches(n, r)).otherwise(F.array().cast(_MATCHES)) for n, r in enumerate(rules)]
    rows = texts.select("k", F.explode(F.concat(*pieces)).alias("x")).select("k", "x.*").filter("whole is not null")  # the last piece has no match after it
    upto = F.sum((F.col("gap") + F.col("whole")).cast("long")).over(Window.partitionBy("k", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", upto).filter("good").select("k", "rule", (F.col("end") - F.col("whole")).alias("start"), "end")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets in each whole text: one row per input row.

    docs needs doc_id and text; other columns, whatever their names, are not read.
    Returns doc_id, a count n_<kind> per base rule, base_spans and spans
    (kind:start:end in code points, end exclusive, by start, then rule order;
    comma-joined; empty if none). A null text is empty; repeated rows and equal
    texts get equal results; an empty table gives none.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("k"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [n for n, r in enumerate(rules) if r.base]
    counts = [f"n_{rules[n].kind}" for n in base]

    def joined(items) -> F.Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"], x["end"])), ",")

    ordered = F.sort_array(F.collect_list(F.struct("start", "rule", "end")))
    per_text = _spans(keyed, rules).groupBy("k").agg(*[F.count_if(F.col("rule") == n).alias(c) for n, c in zip(base, counts, strict=True)], ordered.alias("all"))
    per_text = per_text.select("k", *counts, joined(F.filter("all", lambda x: x["rule"].isin(*base))).alias("base_spans"), joined(F.col("all")).alias("spans"))
    out = keyed.select("doc_id", "k").join(stage(per_text, "secret-spans"), "k", "left")  # staged, so that AQE can split a large group of copies
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span replaced by mark (overlapping spans by one) and n_chars brought up to date.

    docs needs doc_id and text; n_chars, where there is one, is set for changed texts. Null
    texts stay null, empty ones empty; long texts are scanned whole; other columns, whatever their names (but __key, __k, __cuts and __text), and
    all rows stay as they are, equal ones alike; an empty table gives none.
    """
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("k")).filter("text is not null")
    w = Window.partitionBy("k").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = _spans(keyed, rules).withColumn("new", (before.isNull() | (F.col("start") >= before)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("k", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    nxt = F.lead("start").over(Window.partitionBy("k").orderBy("island"))
    cuts = merged.withColumn("next", nxt).groupBy(F.col("k").alias("__k")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "next"))).alias("__cuts"))
    marked = docs.withColumn("__key", text_key(F.col("text")))
    joined = marked.join(stage(cuts, "secret-cuts"), F.col("__key") == F.col("__k"), "left")
    whole = F.length("text")
    rest = F.transform("__cuts", lambda x: F.concat(F.lit(mark), F.substring(F.col("text"), (x["end"] + 1).cast("int"), (F.coalesce(x["next"], whole) - x["end"]).cast("int"))))
    text = F.when(F.col("__cuts").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), F.get("__cuts", F.lit(0))["start"].cast("int")), F.array_join(rest, "")))
    changed = joined.withColumn("__text", text)
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("__cuts").isNull(), F.col(c)).otherwise(F.length("__text").cast(kind)).alias(c))
        else:
            columns.append(F.col(c))
    return changed.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def _oracle() -> str:
    """DuckDB: each rule scans every text; a match starts after all pieces and matches before it."""
    scans = []
    for n, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        scans.append(f"SELECT row, {n} AS rule, string_split_regex(t, '{regex}') AS p, regexp_extract_all(t, '{regex}', 0) AS w, regexp_extract_all(t, '{regex}', {r.group}) AS g, {r.least} AS least FROM d")
    kinds = ", ".join(f"'{r.kind}'" for r in RULES)
    base = ", ".join(str(n) for n, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"count_if(rule = {n}) AS n_{r.kind}" for n, r in enumerate(RULES) if r.base)
    names = [f"n_{r.kind}" for r in RULES if r.base]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
s AS ({" UNION ALL ".join(scans)}),
m AS (SELECT row, rule, i, length(p[i]) AS gap, length(w[i]) AS whole, length(g[i]) >= least AS good FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s)),
x AS (SELECT row, rule, good, whole, CAST(sum(gap + whole) OVER (PARTITION BY row, rule ORDER BY i) AS BIGINT) AS stop FROM m),
f AS (SELECT row, rule, stop - whole AS start, ([{kinds}])[rule + 1] || ':' || (stop - whole) || ':' || stop AS span FROM x WHERE good),
a AS (SELECT row, {counts}, string_agg(span, ',' ORDER BY start, rule) FILTER (WHERE rule IN ({base})) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans FROM f GROUP BY row)
SELECT doc_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in names)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.row = a.row
"""


ORACLE = _oracle()
