"""Source divergence audit: how far each source's vocabulary is from the others of its language.

Terms are runs of letters (A-Z, a-z and everything beyond ASCII), A-Z in lower case.  A language keeps
its V terms found in at least ``min_docs`` of its documents.  Each (lang, source) group and each language
gives every kept term p = 1 + floor(SCALE * (count + 1) / (N + V)), N its count of kept terms, and the
divergence of p from q at a term is floor((p - q)^2 / q).  All of it is integer arithmetic.

Strings are materialized late:

1. One pass counts the terms of each task's documents: a row per language and term, with its string
   and the counts of its sources.  Only the 64-bit digest of the term and the counts are shuffled, once,
   to be summed by source and by language, which also settles V and N; the strings stay behind.
2. Of the digests kept, the strings are looked at: the smallest and the largest of each digest.  Where they
   differ, several terms share the digest and it is split: a second pass counts the terms of such
   digests alone, and these carry their string from there on.  (Without such digests there is none.)
3. The terms of split digests are summed and judged one by one, in place of their digest.
4. ``term``: each group's highest values are found on digests, with all ties at the border; only
   these rows meet their strings, which decide the ties.
5. ``pair``: the sum over all V terms is put together without touching a term that neither source has,
       V f(a0, b0) + sum over a's terms of f(p, b0) - f(a0, b0) + sum over b's terms of f(a0, p) - f(a0, b0)
       + sum over common terms of f(p, r) - f(p, b0) - f(a0, r) + f(a0, b0)
   (a0, b0: p at count 0).  The second and third come from each source's histogram of p, the last from
   tasks that hold whole terms and add up into one number for each pair of sources.

Defined cases: null text, lang and source are ''; a document is a row, so rows that repeat a doc_id count
each; a group without kept terms gives all of them count 0; V = 0 gives pairs of value 0 and no terms;
ties go to the smaller item in UTF-8 order; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from petrograph.llm.common import batch, columns, discard, likely_among, saved

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Distinct (group, term) counts of a task before it hands them on; kept entries looked at together.
TERMS_HELD, ENTRIES_HELD, CELLS = 500_000, 100_000, 1 << 21
#: Split digests up to this many are sent to the tasks (8 bytes each); beyond it they are joined in a shuffle.
FEW = 100_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


ENTRY = pa.struct([("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTS = pa.schema([("lang", pa.string()), ("digest", pa.int64()), ("word", pa.string()), ("entries", pa.list_(ENTRY))])
COUNTS_DDL = "lang string, digest bigint, word string, entries array<struct<source: string, n: bigint, docs: bigint>>"
#: Rows of a batch that is handed on.
OUT_ROWS = 50_000


def digests(names: list[bytes], bits: int) -> np.ndarray:
    """64-bit hashes of the terms, cut to their first ``bits`` bits."""
    from xxhash import xxh3_64_intdigest

    whole = np.fromiter(map(xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
    return (whole >> np.uint64(64 - bits)).view(np.int64)


def counting(bits: int, only: np.ndarray | None = None):
    """Counts by language, term and source of a task's documents; digests of ``bits`` bits, of ``only`` if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, tuple[Counter, Counter]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, sources in held.items():
                names = list(set().union(*(n for n, _ in sources.values())))
                digest = digests(names, bits)
                if only is not None:
                    keep = np.flatnonzero(np.isin(digest, only))
                    names, digest = [names[i] for i in keep.tolist()], digest[keep]
                if not names:
                    continue
                place = {t: i for i, t in enumerate(names)}
                at, code, ns, ds = [], [], [], []
                for c, (n, docs) in enumerate(sources.values()):
                    mine = n if only is None else [t for t in n if t in place]
                    at.append(np.fromiter(map(place.__getitem__, mine), np.int64, len(mine)))
                    code.append(np.full(len(mine), c, dtype=np.int32))
                    ns.append(np.fromiter(map(n.__getitem__, mine), np.int64, len(mine)))
                    ds.append(np.fromiter(map(docs.__getitem__, mine), np.int64, len(mine)))
                rows = np.concatenate(at)
                order = np.argsort(rows, kind="stable")
                source = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(code)[order]), pa.array(list(sources), pa.string()))
                entry = pa.StructArray.from_arrays([source.cast(pa.string()), pa.array(np.concatenate(ns)[order]),
                                                    pa.array(np.concatenate(ds)[order])], fields=list(ENTRY))
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(names))))).astype(np.int32)
                whole = batch(COUNTS, [pa.repeat(pa.scalar(lang, pa.string()), len(names)), pa.array(digest),
                                       pa.array(names, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), entry)])
                for begin in range(0, len(names), OUT_ROWS):
                    yield whole.slice(begin, OUT_ROWS)
            held.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(*columns(b, "lang", "source", "text"), strict=True):
                n, docs = held.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                found = terms(text)
                size -= len(n)
                n.update(found)
                docs.update(set(found))
                size += len(n)
                if size > TERMS_HELD:
                    yield from out()
                    size = 0
        yield from out()
    return run


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two bigint columns up to SCALE + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def share(count: str, total: str, size: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + size)); null where both are 0."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10,0)) * cast({count} + 1 AS decimal(20,0)))"
                  f" div cast(nullif({total} + {size}, 0) AS decimal(20,0))").cast("bigint")


def summed(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, digest, split, n, total, first) of terms with enough documents, from rows of counts.

    Rows without a column split are of digests that aren't split.
    """
    # Dealt by term alone: the sums by source and the sums by term need no further shuffle.
    term = [c for c in ("lang", "digest", "split") if c in counts.columns]
    by_term = W.partitionBy(*term)
    each = counts.select(*term, "entries").repartition(*term).select(*term, F.inline("entries"))
    split = "split" if "split" in term else F.lit("").alias("split")
    return (each.groupBy(*term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumn("_docs", F.sum("docs").over(by_term)).withColumn("total", F.sum("n").over(by_term))
            .withColumn("first", F.col("source") == F.min("source").over(by_term))
            .filter(F.col("_docs") >= min_docs)
            .select("lang", "source", "digest", split, "n", "total", "first"))


def kept_counts(documents: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, split, n, total, first) of the kept terms, and (digest, split, word).

    split is '' or, where terms share a digest, the term; total is the language's count of the term;
    first marks one source of each term.
    """
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = saved(docs.mapInArrow(counting(bits), COUNTS_DDL), "terms")
    # A digest has at least as many documents as any of its terms, so no kept term is missed here.
    kept = saved(summed(counts, min_docs), "kept")
    spelt = saved(likely_among(counts.select("digest", "word"), "digest", kept.filter("first").select("digest"))
                  .groupBy("digest").agg(F.min("word").alias("word"), F.max("word").alias("last")), "words")
    discard(counts)
    shared = spelt.filter("word <> last").select("digest")
    words = spelt.filter("word = last").select("digest", F.lit("").alias("split"), "word")
    n_shared = shared.count()
    if n_shared:
        few = n_shared <= FEW       # the list is 8 bytes a digest; beyond that it stays a table
        only = np.array([r["digest"] for r in shared.collect()], dtype=np.int64) if few else None
        shared = F.broadcast(shared) if few else shared
        again = saved(docs.mapInArrow(counting(bits, only), COUNTS_DDL).join(shared, "digest", "left_semi"), "split")
        again = again.withColumn("split", F.col("word"))
        kept = saved(kept.join(shared, "digest", "left_anti").select(*kept.columns).unionByName(summed(again, min_docs)), "kept")
        words = words.unionByName(again.select("digest", "split", "word").distinct())
    return kept, words


def groups(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n_terms (N), size (V), p0, lang_terms (the language's N) of every group that occurs."""
    every = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_terms"))
    of_lang = kept.filter("first").groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("total").alias("lang_terms"))
    zero = {"n_terms": 0, "size": 0, "lang_terms": 0}
    return (every.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(zero)
            .select("*", share("0", "n_terms", "size").alias("p0")))


BOTH = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("high", pa.int64()),
                  ("low", pa.int64())])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by term: the last sum of the pair formula for each (lang, source, other source).

    Sums are kept as high * 2**32 + low, so that they are exact whatever their size.
    """
    sums: dict[tuple[str, str, str], list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in sums.items()]
        sums.clear()
        return batch(BOTH, [list(c) for c in zip(*rows, strict=True)])

    def add(lang: str, every: list[str], term: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        codes, at = np.unique(source, return_inverse=True)
        names = [every[c] for c in codes]
        base = np.zeros(len(names), dtype=np.int64)
        base[at] = p0
        step = max(1, CELLS // len(names))
        for begin in range(0, int(term[-1]) + 1, step):
            cut = slice(*np.searchsorted(term, (begin, begin + step)))
            cells = np.zeros((min(step, int(term[-1]) + 1 - begin), len(names)), dtype=np.int64)
            cells[term[cut] - begin, at[cut]] = p[cut]
            for g, name in enumerate(names):
                rows = cells[cells[:, g] > 0]
                own, safe = rows[:, g:g + 1], np.where(rows > 0, rows, 1)
                f = ((own - safe) ** 2 // safe - (own - base) ** 2 // base
                     - (base[g] - safe) ** 2 // safe + (base[g] - base) ** 2 // base)
                f[rows == 0] = 0
                met = (rows > 0).any(axis=0)
                for h in np.flatnonzero(met):
                    if h != g:
                        total = sums.setdefault((lang, name, names[h]), [0, 0])
                        total[0] += int((f[:, h] >> 32).sum())
                        total[1] += int((f[:, h] & 0xFFFFFFFF).sum())

    def whole(t: pa.Table) -> None:
        coded = {c: t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")}
        lang, source = (coded[c].indices.to_numpy() for c in ("lang", "source"))
        names = {c: coded[c].dictionary.to_pylist() for c in coded}
        digest, split, p, p0 = (t.column(c).to_numpy() for c in ("digest", "split", "p", "p0"))
        new = np.ones(len(lang), dtype=bool)
        new[1:] = (digest[1:] != digest[:-1]) | (lang[1:] != lang[:-1]) | (split[1:] != split[:-1])
        edge = np.flatnonzero(np.concatenate(([True], lang[1:] != lang[:-1], [True])))
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            add(names["lang"][lang[a]], names["source"], np.cumsum(new[a:z]) - 1, source[a:z], p[a:z], p0[a:z])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < ENTRIES_HELD:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = [t.column(c)[-1].as_py() for c in ("lang", "digest", "split")]
        cut = size
        while cut and [t.column(c)[cut - 1].as_py() for c in ("lang", "digest", "split")] == last:
            cut -= 1
        if cut:
            whole(t.slice(0, cut))
        held, size = t.slice(cut).to_batches(), size - cut
        if len(sums) > TERMS_HELD:
            yield out()
    if size:
        whole(pa.Table.from_batches(held).combine_chunks())
    if sums:
        yield out()


def pair_values(entries: DataFrame, all_groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each pair of sources of a language; the formula is in the module's text."""
    exact = "decimal(38,0)"
    g = all_groups.select("lang", "source", "size", "p0")
    other = all_groups.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    both_named = (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item"))
    neither = g.join(other, both_named).select(
        "lang", "source", "item", (F.col("size").cast("decimal(19,0)") * F.coalesce(divergence("p0", "q0"), F.lit(0))
                                   .cast("decimal(19,0)")).cast(exact).alias("value"))
    seen = entries.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("terms"))
    met = seen.join(other, both_named)
    base = divergence("p0", "q0")
    one = met.select("lang", "source", "item", (F.col("terms") * (divergence("p", "q0") - base).cast("decimal(19,0)"))
                     .cast(exact).alias("value"))
    # The same histogram read as the other side's: item and source change places.
    two = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                     (F.col("terms") * (divergence("q0", "p") - divergence("q0", "p0")).cast("decimal(19,0)"))
                     .cast(exact).alias("value"))
    common = (entries.select("lang", "source", "digest", "split", "p", "p0").repartition("lang", "digest", "split")
              .sortWithinPartitions("lang", "digest", "split")
              .mapInArrow(_common, "lang string, source string, item string, high bigint, low bigint")
              .select("lang", "source", "item", (F.col("high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)")
                                                 + F.col("low").cast("decimal(20,0)")).cast(exact).alias("value")))
    return (neither.unionByName(one).unionByName(two).unionByName(common).groupBy("lang", "source", "item")
            .agg(F.sum("value").cast("bigint").alias("value")))


def term_values(entries: DataFrame, words: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of each group's ``top`` terms above the language's share."""
    above = entries.filter("p > q").select("lang", "source", "digest", "split", divergence("p", "q").alias("value"))
    group = W.partitionBy("lang", "source")
    high = (above.withColumn("_rank", F.rank().over(group.orderBy(F.desc("value")))).filter(F.col("_rank") <= top)
            .drop("_rank"))
    named = high.join(words, ["digest", "split"]).select("lang", "source", F.col("word").alias("item"), "value")
    return (named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
            .filter(F.col("rank") <= top))


def audited(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank (see the module's text)."""
    kept, words = kept_counts(documents, min_docs, bits)
    every = saved(groups(documents, kept), "groups")
    entries = kept.join(every, ["lang", "source"]).select(
        "lang", "source", "digest", "split", share("n", "n_terms", "size").alias("p"),
        share("total", "lang_terms", "size").alias("q"), "p0")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(entries, every).withColumn("rank", rank)
    parts = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
             for name, df in (("pair", pairs), ("term", term_values(entries, words, top)))]
    return parts[0].unionByName(parts[1])


#: The same rows in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS size, sum(total) AS lang_terms FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n_terms FROM (SELECT DISTINCT lang, source FROM d) x
      LEFT JOIN c USING (lang, source) GROUP BY lang, source),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.n_terms + v.size) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (k.total + 1)) // (v.lang_terms + v.size) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
above AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
          FROM e WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above) u)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""
