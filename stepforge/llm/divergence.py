"""How far the sources of a language stand apart in the terms they use.

Documents are counted where they lie, and (lang, source, term) counts are summed before and in one shuffle. The sums are
dealt to shards by a hash of lang and term, so a shard has all sources of a term and no language or source fills one; the number of shards
follows the number of counts. In a shard DuckDB runs the audit as SQL over Arrow tables: it counts the documents of each
term over the sources and keeps the frequent ones, and, when Spark has summed up the totals of all shards, it gives the shard's
part of every pair's sum and the best terms of every source. Spark adds up the parts and ranks them.

Most sources lack most terms. So a pair's sum starts from what it would be if neither had any, V * |p(0) - q(0)|, and a
shard adds |p - q| - |p(0) - q(0)| for the terms that one of the two has.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from tempfile import TemporaryDirectory

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import kept, ready, settle

LEAST_DOCS, SMOOTHING, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Counts in a shard, about; counts that a task holds before it hands them on.
SHARD_ROWS, HELD = 200_000, 300_000
#: What DuckDB takes in a task before it spills.
MEMORY = "256MB"

#: A byte of a term in lower case, or a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs; the empty term stands for the group itself and its documents."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> pa.RecordBatch:
        out = [(*group, term, n[term], k) for group, (n, docs) in counts.items() for term, k in docs.items()]
        columns = list(zip(*out, strict=True))
        counts.clear()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns[2] = [t.decode("utf-8", "surrogatepass") for t in columns[2]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

    held = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = counts[lang, source]
            before, words = len(docs), terms_of(text)
            n.update(words)
            docs.update(set(words))
            docs[b""] += 1
            held += len(docs) - before
            if held > HELD:
                yield rows()
                held = 0
    if counts:
        yield rows()
    settle()


def _answer(sql: str, **tables: pa.Table) -> pa.Table:
    """The rows of sql over Arrow tables; a sort or join beyond the memory goes to a scratch folder that ends with the call."""
    with TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
        for name, rows in tables.items():
            con.register(name, rows)
        return con.sql(sql).to_arrow_table()


FREQUENT = """
SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS head
FROM counts WHERE term <> '' QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}
"""

_SHARE = "1 + ({scale}::HUGEINT * ({n} + {smoothing})) // ({total} + {smoothing} * {terms}::HUGEINT)"


def _share(n: str, total: str, terms: str) -> str:
    return _SHARE.format(scale=SCALE, smoothing=SMOOTHING, n=n, total=total, terms=terms)


AUDIT = f"""
WITH sources AS (SELECT *, {_share("0", "total", "terms")} AS zero FROM groups WHERE terms > 0),
present AS (SELECT c.lang, c.source, c.term, {_share("n", "total", "terms")} AS p, zero FROM counts c JOIN sources USING (lang, source)),
whole AS (SELECT c.lang, c.term, {_share("sum(n)", "any_value(lang_total)", "any_value(terms)")} AS q FROM counts c JOIN sources USING (lang, source) GROUP BY c.lang, c.term),
best AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM present JOIN whole USING (lang, term) WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {{ranks}}
), pairs AS (
    SELECT a.lang, least(a.source, s.source) AS source, 'pair' AS part, greatest(a.source, s.source) AS item, sum(abs(a.p - coalesce(b.p, s.zero)) - abs(a.zero - s.zero))::BIGINT AS value
    FROM present a JOIN sources s ON s.lang = a.lang AND s.source <> a.source
    LEFT JOIN present b ON b.lang = s.lang AND b.source = s.source AND b.term = a.term
    WHERE b.p IS NULL OR a.source < b.source GROUP BY ALL
)
SELECT * FROM best UNION ALL SELECT * FROM pairs
"""


def _frequent(least: int):
    def run(counts: pa.Table) -> pa.Table:
        rows = _answer(FREQUENT.format(least=least), counts=counts)
        return rows.append_column("shard", pa.repeat(counts.column("shard")[0], rows.num_rows)).cast(_FREQUENT)

    return run


_FREQUENT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("head", pa.int64()), ("shard", pa.int32())])
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _audited(ranks: int):
    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        if not counts.num_rows:
            return _PARTS.empty_table()
        return _answer(AUDIT.format(ranks=ranks), counts=counts, groups=groups).cast(_PARTS)

    return run


def audited(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the distance of every other one, and its most overused terms.

    Null text, lang and source are ''; empty texts have no terms, and their groups occur all the same; very long texts are counted whole. Each row is a document,
    rows that repeat too. Ties go to the smaller item by UTF-8 bytes. Other columns are not read; an empty table gives an empty result."""
    spark = ready(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = kept(counts, "audit-counts")
    shards = max(spark.sparkContext.defaultParallelism, -(-counts.count() // SHARD_ROWS))
    sharded = counts.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    frequent = kept(sharded.groupBy("shard").applyInArrow(_frequent(least), "lang string, source string, term string, n long, head long, shard int"), "audit-frequent")

    totals = frequent.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total", "heads"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"))
    groups = kept(groups.drop("heads").join(langs, "lang"), "audit-groups")

    copies = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = kept(frequent.groupBy("shard").cogroup(copies.groupBy("shard")).applyInArrow(_audited(ranks), "lang string, source string, part string, item string, value long"), "audit-parts")

    zero = F.expr(f"case when terms > 0 then 1 + {SCALE * SMOOTHING} div (total + {SMOOTHING} * terms) end").alias("zero")
    a = groups.select("lang", "source", "terms", zero)
    b = groups.select("lang", F.col("source").alias("item"), zero.alias("other"))
    start = a.join(b, "lang").filter("source < item").select("lang", "source", "item", F.coalesce(F.col("terms") * F.abs(F.col("zero") - F.col("other")), F.lit(0)).alias("value"))
    sums = start.unionByName(parts.filter("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("of")
    pairs = sums.select("lang", both, "value").select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
