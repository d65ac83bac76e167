"""Line dedup, source divergence and structure repair against plain Python on small tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from petrograph.llm import divergence, line_dedup, repair

SCHEMA = ("doc_id bigint, text string, lang string, source string, digest string, places string, hash string, n bigint, "
          "split string, rank string, value string, term string, lines string, batch string")
CLASH = ("clash",) * 3 + (7,) + ("clash",) * 6
LONG = "\n".join(f"Line {i % 900} of a long Text" for i in range(20_000))


def corpus():
    """(doc_id, text, lang, source) with repeated lines, nulls, edges and repeated rows."""
    rng = random.Random(3)
    line = lambda: "".join(rng.choice(["Ab ", "c", "É", "zz", ".", "7", "的"]) for _ in range(rng.randint(0, 5)))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 12))) for _ in range(40)]
    texts += ["", None, "\n\n", "  Shared LINE\t", "shared line\n\x0bx\r", "x\nSHARED line", "é\nÉ", LONG, LONG[:40_000], texts[0], texts[0]]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "en", "s0"), (3, texts[4], "en", "s0"), (None, texts[5], "de", None), (None, None, None, None),
                   (90, "only here", "zz", "a"), (91, None, "zz", "b"), (92, "7 7", "yy", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in corpus()], SCHEMA).repartition(3).cache()


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


# -- lines -----------------------------------------------------------------------------------
def brute_lines(rows, min_docs, least):
    keys = [[low(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t, *_ in rows]
    found = collections.Counter(k for doc in keys for k in set(doc) if len(k) >= least)
    out = []
    for (doc_id, text, *_), doc in zip(rows, keys, strict=True):
        kept = [x for x, k in zip((text or "").split("\n"), doc, strict=True) if found[k] < min_docs]
        out.append((doc_id, len(doc), len(doc) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs, least, batches, fanout", [(10, 1, 4, 3), (3, 1, 5, 2), (2, 4, 1, 2)])
def test_lines(docs, min_docs, least, batches, fanout):
    got = line_dedup.digests(line_dedup.without_common_lines(docs, min_docs, least, batches, fanout))
    assert table(got) == brute_lines(corpus(), min_docs, least)


def test_lines_rare_and_hot_ways_agree(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 1)       # nothing is hot: all keys take the shuffle
    assert table(line_dedup.digests(line_dedup.without_common_lines(docs, 3))) == brute_lines(corpus(), 3, 1)


def test_line_runs_grow_batch_by_batch(spark):
    index = line_dedup.LineRuns(spark, min_docs=4, fanout=2)
    counted = collections.Counter()
    rng = random.Random(1)
    for size in (1, 2, 3, 4, 5, 6, 7):
        keys = [rng.choice("abcdefgh").encode() for _ in range(size * 2)]
        counted.update(keys)
        index.add(spark.createDataFrame([(k,) for k in keys], "hash binary"))
        assert {bytes(r.hash) for r in index.frequent().collect()} == {k for k, n in counted.items() if n >= 4}
    assert [len(level) for level in index.levels] == [1, 1, 1]      # 7 batches, two runs merging into one
    settled = index.levels[2][0].filter("n >= 4").count()
    assert settled and all(run.join(index.levels[2][0].filter("n >= 4"), "hash").count() == 0
                           for run in (index.levels[0][0], index.levels[1][0]))
    index.drop()


def test_lines_empty(spark):
    got = line_dedup.digests(line_dedup.without_common_lines(spark.createDataFrame([], SCHEMA)))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and got.count() == 0


# -- divergence ------------------------------------------------------------------------------
def brute_divergence(rows, min_docs=3, top=200):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or ""))) for _, t, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in words}:
        mine = [(s, w) for x, s, w in words if x == lang]
        held = collections.Counter(t for _, w in mine for t in set(w))
        kept = [t for t, n in held.items() if n >= min_docs]
        count = {s: collections.Counter(t for x, w in mine if x == s for t in w) for s, _ in mine}
        everywhere = sum(count.values(), collections.Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // total for t in kept}

        q, p = shares(everywhere), {s: shares(c) for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            high = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", high)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, top", [(64, 200), (4, 200), (64, 3)])
def test_divergence(docs, bits, top):
    """With 4 bits many terms share a digest and are split."""
    assert table(divergence.audited(docs, top=top, bits=bits)) == brute_divergence(corpus(), top=top)


def test_divergence_in_small_pieces(docs, monkeypatch):
    for name in ("TERMS_HELD", "ENTRIES_HELD", "CELLS", "FEW"):
        monkeypatch.setattr(divergence, name, 3)
    assert table(divergence.audited(docs, bits=5)) == brute_divergence(corpus())


def test_divergence_empty(spark):
    assert divergence.audited(spark.createDataFrame([], SCHEMA)).count() == 0


# -- repair ----------------------------------------------------------------------------------
def every_edit(rows):
    """The cheapest and then least edit list, by trying all of them."""
    found = []

    def go(i, roles, cost, edits, inserted):
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, edits))
        else:
            initial, must_go, truncated = rows[i]
            go(i + 1, roles, cost + 4, edits + "D", inserted)
            if not must_go:
                go(i + 1, roles + initial, cost + 3 * truncated, edits + "K", inserted)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + 3 * truncated, edits + "R", inserted)
        if inserted < 4:
            for r in "ua":
                go(i, roles + r, cost + 3, edits + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return min(found)


def best_of_states(rows):
    """The same by keeping whole edit lists for each state."""
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]

    def inserted(best):
        for _ in range(4):
            for state, (cost, edits) in list(best.items()):
                to = step[state].get("u") or step[state]["a"]
                best[to] = min(best.get(to, (10 ** 9, "")), (cost + 3, edits + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, must_go, truncated in rows:
        after = {}
        for state, (cost, edits) in best.items():
            ways = [(state, cost + 4, edits + "D")]
            if not must_go:
                ways += [(to, cost + 3 * truncated + 3 * (r != initial), edits + "KR"[r != initial])
                         for r, to in step[state].items() if r == initial or r in "ua"]
            for to, c, e in ways:
                after[to] = min(after.get(to, (10 ** 9, "")), (c, e))
        best = inserted(after)
    return min(best[s] for s in (0, 3) if s in best)


def streamed(rows):
    walk, edits = repair.Repair(), ""
    for row in rows:
        edits += "".join(letter for letter, _ in walk.row(*row))
    cost, rest = walk.end()
    return cost, edits + "".join(letter for letter, _ in rest), walk


def test_repair_finds_the_cheapest_and_least_edits():
    rng = random.Random(7)
    for n in range(1200):
        rows = [(rng.choice("suat" if n % 2 else "ua"), rng.random() < .2, rng.random() < .3) for _ in range(rng.randint(0, 12))]
        assert streamed(rows)[:2] == best_of_states(rows)
    for rows in itertools.product([("s", False, False), ("u", False, True), ("a", False, False), ("x", True, False)], repeat=3):
        assert streamed(rows)[:2] == every_edit(rows)


def test_repair_memory_follows_the_open_stretch():
    rng = random.Random(8)
    mixed = [(rng.choice("usat"), rng.random() < .1, rng.random() < .1) for _ in range(20_000)]
    assert len(streamed(mixed)[2].tree.letter) < 200
    unknown = [("t", False, False)] * 5_001          # both parities stay open to the end
    cost, edits, _ = streamed(unknown)
    assert (cost, edits) == best_of_states(unknown)


def conversations():
    rng = random.Random(4)
    said = ["Yes.", "No!", "why?", "cut off", " ", "", None, "Yes.", "é 的 x.", "\x0b."]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None]), rng.choice(said))
            for c in (*range(60), None) for t in [None, *range(rng.randint(0, 9))] if rng.random() < .9]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 50 else "again.") for t in range(700)]
    return rows + rows[:7]


def brute_repair(rows):
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[c] += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, mine in groups.items():
        mine.sort()
        seen, faults = set(), []
        for _, _, role, text in mine:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else
                          "truncated" if stripped[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, edits = best_of_states([(r[:1], f in ("blank", "duplicate"), f == "truncated")
                                      for (_, _, r, _), f in zip(mine, faults, strict=True)])
        told, rows_left = [], iter(mine)
        for e in edits:
            row = next(rows_left) if e != "I" else None
            if e == "D":
                continue
            place = len(told) - (bool(told) and told[0][0][:1] == "s")
            told.append((row[2] if e == "K" else "ua"[place % 2] == "u" and "user" or "assistant", "" if e == "I" else row[3]))
        turns = [t for known, t, _, _ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, _, r, _ in mine]
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, edits,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in conversations()],
                                 "conv_id bigint, turn bigint, role string, text string, fault string, edit string, place int")


def test_repair(talks):
    assert table(repair.audited(repair.damaged(talks))) == brute_repair(conversations())


def test_repair_equals_its_sql(talks):
    con = duckdb.connect()
    frame = talks.toPandas()  # noqa: F841
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, \"text\" FROM frame")
    got = repair.audited(repair.damaged(talks))
    assert table(got) == sorted(con.sql(repair.SQL).select(*got.columns).fetchall(), key=str)


def test_repaired_rows_and_audit_agree(talks):
    audits = {r.conv_id: r for r in repair.audited(repair.damaged(talks)).collect()}
    rows = collections.defaultdict(list)
    edits = collections.Counter()
    for r in repair.repaired(repair.damaged(talks)).collect():
        edits[r.conv_id, r.edit] += 1
        if r.place is not None:
            rows[r.conv_id].append((r.place, r.role, r.text))
    for c, audit in audits.items():
        mine = sorted(rows[c])
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in mine))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in mine).encode()).hexdigest() == audit.repaired_sha256
        assert all(edits[c, e] == audit.audit.count(e) for e in "KRDI")


def test_repair_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.audited(repair.damaged(none)).count() == 0 and repair.repaired(none).count() == 0
    announced = none.sparkSession.createDataFrame([(5, 0, "user", "x.")], none.schema).withColumn("present", F.lit(False))
    row = repair.audited(announced).first()
    assert row.conv_id == 5 and row.audit == "" and row.cost == 0 and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()
