"""Secret scans by a trigram inverted index; DataFrame functions only.

Each rule's regex is turned into a Boolean query: its alternatives' literal runs give the trigrams that any
match must hold (OR over alternatives, AND within one). Postings (trigram, document) are kept for the
trigrams that some query names; joining them with the queries and counting intersects them. Candidates are
verified with the rule's regex on the whole text. Rules without mandatory trigrams scan every text.

Before the candidates are joined, texts are dropped that lack every alternative's least common trigram (by
its letters), so that only texts likely to match move if the candidates are too many to broadcast.

Positions: a lazy gap before each match, ``(.*?)(rule|\\z)``, cuts the whole text in one linear pass; the
lengths of gaps and matches are summed by a window for each document and rule. Nothing is quadratic in the
number of matches.

Defined results: null text is empty; a row is known by its id and text, so repeated rows each get their
result and equal ids with other texts are kept apart; null ids are kept; an empty table gives no rows;
further columns are ignored or, by ``mask_secrets``, kept, whatever their names. A text's hash (64 bits) and its
row's id together name it.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import quoted, stored, table, unused

#: Candidates, and spans to mask, that are broadcast at most; beyond it they are shuffled. A row takes at most some
#: dozen bytes: its id, its text's hash and the rules it may meet, or the two ends of a span.
BROADCAST_CANDIDATES = 500_000


@dataclass(frozen=True)
class Rule:
    """A kind's regex; ``group`` (0: the match) must have ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base kinds come first, in the order in which spans that begin together are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs that are too short can't hold a long one, so the least length may stand in the regex.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def trigram_query(regex: str, most: int = 64) -> list[frozenset[str]]:
    """The regex as OR of ANDs of lower-case trigrams; empty if some alternative has none."""
    done = walk(sre.parse(regex), [((), "")], most)
    query = [frozenset(f[i : i + 3] for f in (*closed, run) for i in range(len(f) - 2)) for closed, run in done]
    return [] if not all(query) else sorted(set(query), key=sorted)


def walk(items, states: list, most: int) -> list:
    """States are (closed literal runs, open run) of each alternative so far."""

    def gap(states):
        return list(dict.fromkeys(((*c, r) if r else c, "") for c, r in states))

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            states = [(c, r + chr(value).lower()) for c, r in states]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(chars := sorted({chr(v).lower() for _, v in value})) * len(states) <= most:
            states = [(c, r + x) for c, r in states for x in chars]
        elif name == "SUBPATTERN":
            states = walk(value[3], states, most)
        elif name == "BRANCH":
            branched = [s for b in value[1] for s in walk(b, states, most)]
            states = branched if len(branched) <= most else gap(states)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, largest, inner = value
            if (least, largest) == (0, 1) and not (len(inner) == 1 and str(inner[0][0]) == "IN"):
                states = list(dict.fromkeys([*states, *walk(inner, states, most)]))
            elif least == 0:
                states = gap(states)
            else:
                states = walk(inner, states, most)
                states = states if largest == 1 else gap(states)
        elif name != "AT":
            states = gap(states)
        if len(states) > most:
            states = gap([((), "")])
    return states


def _pieces(text: Column, order: int, rule: Rule) -> Column:
    """Of each match: the rule's number, characters before it since the last one, its own, the group's."""
    pattern = F.lit(rf"(?s)(.*?)({rule.regex}|\z)")
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(2 + rule.group)).alias("part"),
    )
    return F.transform(zipped, lambda x: F.struct(F.lit(order).alias("rule"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["part"]).alias("part")))


def candidates(docs: DataFrame, queries: dict[int, list[frozenset[str]]]) -> tuple[DataFrame, Column]:
    """(doc_id, _h, rules) that meet a rule's query, and the test for each alternative's rarest trigram."""
    spark = docs.sparkSession
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    # Within a lambda the lower-cased text is made once; as a plain expression each condition makes its own.
    low = F.array(F.lower("text"))
    held = F.get(F.transform(low, lambda x: F.array_compact(F.array(*(F.when(x.contains(t), F.lit(t)) for t in trigrams)))), F.lit(0))
    postings = docs.select("doc_id", "_h", F.explode(held).alias("trigram"))
    clauses = spark.createDataFrame([(n, a, t, len(alt)) for n, q in queries.items() for a, alt in enumerate(q) for t in sorted(alt)], "rule int, alternative int, trigram string, needed int")
    # Rules bound the clauses' size. Grouping by document splits frequent trigrams' postings.
    met = postings.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "_h", "rule", "alternative", "needed").agg(F.count("*").alias("n"), F.collect_set("trigram").alias("t"))
    met = met.where(F.size("t") >= F.col("needed"))
    found = stored(met.groupBy("doc_id", "_h").agg(F.collect_set("rule").alias("rules")), "secret-candidates")
    rare = sorted({max(alt, key=_rarity) for q in queries.values() for alt in q})
    return found, F.exists(low, lambda x: reduce(lambda a, b: a | b, (x.contains(t) for t in rare)))


def _rarity(trigram: str) -> tuple[int, str]:
    """Rare letters and signs first: a fixed order, as any choice gives the same result."""
    return sum("etaoinshrdlu".find(c) < 0 for c in trigram), trigram


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_candidates: int = BROADCAST_CANDIDATES) -> DataFrame:
    """(doc_id, _h, spans) for each row: _h is the text's hash, spans are (start, rule's number, end), sorted."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.regex))}
    found = []
    if queries:
        hits, rarest = candidates(docs, queries)
        texts = docs.where(rarest)
        wide = F.broadcast(hits) if hits.count() <= broadcast_candidates else hits
        joined = texts.join(wide, texts["doc_id"].eqNullSafe(wide["doc_id"]) & (texts["_h"] == wide["_h"])).select(texts["doc_id"], texts["_h"], "text", "rules")
        found.append(joined.withColumn("x", F.flatten(F.array(*(F.when(F.array_contains("rules", n), _pieces(F.col("text"), n, rules[n])).otherwise(_pieces(F.lit(""), n, rules[n])) for n in queries)))))
    for n in set(range(len(rules))) - set(queries):
        found.append(docs.where(F.col("text").rlike(rules[n].regex)).withColumn("x", _pieces(F.col("text"), n, rules[n])))
    rows = reduce(DataFrame.unionByName, (f.select("doc_id", "_h", "x") for f in found)).withColumn("_row", F.monotonically_increasing_id())
    pieces = rows.select("doc_id", "_h", "_row", F.posexplode("x").alias("at", "x")).select("doc_id", "_h", "_row", "at", "x.*")
    in_order = Window.partitionBy("doc_id", "_h", "_row", "rule").orderBy("at")
    least = reduce(lambda c, n: c.when(F.col("rule") == n, rules[n].least), range(1, len(rules)), F.when(F.col("rule") == 0, rules[0].least))
    ends = pieces.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(in_order)).where((F.col("whole") > 0) & (F.col("part") >= least))
    # A set: rows that repeat have the same spans.
    spans = ends.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set(F.struct((F.col("end") - F.col("whole")).alias("start"), "rule", "end"))).alias("spans"))
    every = docs.select("doc_id", "_h")
    joined = every.join(spans, every["doc_id"].eqNullSafe(spans["doc_id"]) & (every["_h"] == spans["_h"]), "left")
    return joined.select(every["doc_id"], every["_h"], F.coalesce("spans", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")).alias("spans"))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret replaced by ``[secret]``, and n_chars, if it is there, set to the new length.

    Spans that overlap are masked as one. The parts between spans are cut from the text and joined.
    Texts without secrets stay as they are, null too; other columns are kept.
    """
    found = find_secrets(docs, rules).where(F.size("spans") > 0).distinct()
    before = Window.partitionBy("doc_id", "_h").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    each = found.select("doc_id", "_h", F.posexplode("spans").alias("at", "s")).select("doc_id", "_h", "at", "s.start", "s.end")
    # Each span begins where those before it have ended; those within others vanish.
    each = each.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0).cast("long"))).where(F.col("end") > F.col("from"))
    key, mark, spans, masked = unused(docs, "cut_id", "cut_hash", "cuts", "masked")
    cuts = each.groupBy(F.col("doc_id").alias(key), F.col("_h").alias(mark)).agg(F.array_sort(F.collect_list(F.struct("from", "start", "end"))).alias(spans))
    cuts = stored(cuts, "secret-spans")
    n = cuts.agg(F.coalesce(F.sum(F.size(spans) + 1), F.lit(0)).alias("n")).first()["n"]
    wide = F.broadcast(cuts) if n <= BROADCAST_CANDIDATES else cuts
    text, names = docs["text"], docs.columns
    joined = docs.join(wide, docs["doc_id"].cast("long").eqNullSafe(wide[key]) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == wide[mark]), "left")
    part = lambda s: F.when(s["start"] >= s["from"], F.concat(text.substr(s["from"].cast("int") + 1, (s["start"] - s["from"]).cast("int")), F.lit("[secret]"))).otherwise(F.lit(""))
    tail = F.element_at(spans, -1)["end"].cast("int")
    out = joined.withColumn(masked, F.when(F.col(spans).isNull(), text).otherwise(F.concat(F.array_join(F.transform(spans, part), ""), text.substr(tail + 1, F.length(text)))))
    new = {"text": F.col(masked).alias("text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col(spans).isNull(), docs["n_chars"]).otherwise(F.length(masked).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return out.select(*(new[c] if c in new else quoted(c) for c in names))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_rule(spans: Column, n: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rule"] == n))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = (_of_rule(F.col("spans"), n).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_listed(base, RULES).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans"), RULES).alias("spans"))


QUERIES = {"op1_secrets": op1_secrets}

_SQL_RULES = [
    (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 4),
    *((r.regex, 2) for r in RULES[1:]),
]


def _sql_pieces(n: int) -> str:
    regex, group = _SQL_RULES[n]
    whole = r"(?s)(.*?)(" + regex.replace("'", "''").replace("\\''", "''") + r"|\z)"
    every = lambda g: f"regexp_extract_all(t, '{whole}', {g})"
    return f"SELECT id, {n} AS rule, unnest({every(1)}) AS gap, unnest({every(2)}) AS whole, unnest({every(group)}) AS part, unnest(range(len({every(1)}))) AS pos FROM docs"


_LEAST = "CASE rule " + " ".join(f"WHEN {n} THEN {r.least}" for n, r in enumerate(RULES)) + " END"
_KIND = "CASE rule " + " ".join(f"WHEN {n} THEN '{r.kind}'" for n, r in enumerate(RULES)) + " END"
ORACLES = {
    "op1_secrets": f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({" UNION ALL ".join(_sql_pieces(n) for n in range(len(RULES)))}),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY id, rule ORDER BY pos) AS BIGINT) AS e FROM pieces
), spans AS (
  SELECT id, rule, e - length(whole) AS s, {_KIND} || ':' || CAST(e - length(whole) AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS span
  FROM placed WHERE length(whole) > 0 AND length(part) >= {_LEAST}
)
SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, rule) FILTER (rule < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rule), '') AS spans
FROM docs LEFT JOIN spans USING (id) GROUP BY id, doc_id"""
}
