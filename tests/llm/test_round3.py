"""Vector codes, packing and the source audit against brute force, on edge cases and small tables."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mishap.llm import audit, codes, minhash, packing, quality, toxicity
from mishap.llm.shared import Tables
from tests.llm.test_operators import CLASH, EDGES, docs, prose

public_tokenizers = pytest.importorskip("public_tokenizers")

# 5


def test_no_class_is_repeated_for_its_partner_blocks(spark, monkeypatch):
    """Boilerplate that many texts share without being linked: rows stay in proportion to classes."""
    counts, keep = {}, Tables.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        counts[name] = out.agg(F.sum("n")).first()[0] if name == "blocks" else out.count()
        return out

    monkeypatch.setattr(Tables, "keep", kept)
    rng, found = random.Random(3), []
    common = prose(1, 60)
    for n in (160, 320):
        texts = [f"{common} {prose(rng.random(), 40)}" for _ in range(n)] + [prose(7, 100) + f" {common} x{i}" for i in range(3)]
        counts.clear()
        settings = minhash.Settings(block=16, range=2)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, *texts), settings).collect()}
        assert got == minhash.brute_force(dict(enumerate(texts)))
        assert counts["blocks"] <= 2 * counts["family"] and counts["ranges"] <= counts["family"]
        found.append(counts["blocks"])
    assert found[0] > 100 and found[1] < 2.5 * found[0]


def test_rows_without_words_do_not_link_ids_of_several_rows(spark):
    texts = [prose(1, 30), None, prose(2, 30), None]
    d = docs(spark, *texts).withColumn("doc_id", (F.col("doc_id") / 2).cast("long"))
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(d).collect()} == {(0, 0), (1, 1)}


# 11

CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def compressed(spark, rows, settings=codes.Settings(), kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").select("*", *(F.lit("clash").alias(c) for c in CLASH if c != "label"))
    out = codes.compress(df.repartition(3), settings).collect()
    return sorted((str(tuple(r[c] for c in CODES)) for r in out)), out


def brute_codes(rows, settings=codes.Settings()):
    return sorted(map(str, codes.brute_force(list(rows), settings)))


def test_codes(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 31, 1), (1002, [math.inf] + [0.0] * 31, 1), (1003, [math.nan] * 32, 2)]
    rows += [(1004, [], 1), (None, [0.1] * 32, 1), (7, [0.1] * 32, 3), (1005, [0.5] * 5, None)]
    got, out = compressed(spark, rows)
    assert got == brute_codes(rows)
    # 3 assignments of 16 parts to 64 entries would take 3072 distances
    assert sum(r.cost for r in out) < 0.5 * 3072 * len(out)


def test_codes_of_ties_and_repeated_rows(spark):
    rng = random.Random(6)
    rows = [(i % 150, [float(rng.randint(-1, 1)) for _ in range(16)], 1) for i in range(200)]
    assert compressed(spark, rows, kind="float")[0] == brute_codes(rows)


def test_codes_of_large_components(spark):
    rng = random.Random(7)
    rows = [(i, [float(rng.choice([-1, 1])) * 10.0 ** rng.randint(0, 7) for _ in range(16)], 1) for i in range(60)]
    assert compressed(spark, rows, codes.Settings(entries=8))[0] == brute_codes(rows, codes.Settings(entries=8))
    assert len(compressed(spark, [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [0.0] * 16, 1)])[0]) == 3


@pytest.mark.parametrize("rows", [[], [(1, [0.1, 0.2], 1)], [(1, [], None)], [(1, None, 1)]])
def test_codes_of_few_rows(spark, rows):
    assert compressed(spark, rows)[0] == brute_codes(rows)


def test_codes_without_rounds_and_with_more(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 1) for i in range(120)]
    for rounds in (0, 4):
        s = codes.Settings(parts=4, entries=9, rounds=rounds)
        assert compressed(spark, rows, s)[0] == brute_codes(rows, s)


# 12


def fills(rows):
    """How full each sequence is; offsets must have no gaps and no overlaps."""
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    out = []
    for found in by.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        out.append(end)
    return sorted(out)


@pytest.mark.parametrize("length", [2048, 30, 7, 1])
def test_plan_is_that_of_single_pieces(length):
    rng = random.Random(length)
    for n in (0, 1, 5, 60, 400, 3000):
        sizes = [rng.choice([rng.randint(1, length), rng.randint(1, max(1, length // 4)), length]) for _ in range(n)]
        counts = {s: sizes.count(s) for s in set(sizes)}
        rows, used = packing.plan(counts, length)
        placed, ranks = [], {}
        for size, a, b, sequence, each, offset in rows:
            placed += [(sequence + k // each, offset + k % each * size, size) for k in range(b - a)]
            ranks.setdefault(size, []).extend(range(a, b))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(c)) for s, c in counts.items()}
        assert fills(placed) == packing.brute_plan(sizes, length) and len({p[0] for p in placed}) == used


def test_plan_stays_small():
    rows, used = packing.plan({s: 10**9 + s * 7919 % 1000 for s in range(1, 2049)})
    assert len(rows) < 20_000 and used < 1.001 * sum(s * 10**9 for s in range(1, 2049)) / 2048 + 10**6


ODD = ["it's we'll 'S DON'T<|endoftext|>x <|startoftext|>", "Á é   x y\x1cz\x00q  \t\n\x0b ΑΣ Σ", "İ ſ ǅ ı Ŀ", "1234 12a ½ a_b__ ''s", "̸ ≮ \n̸x é", "\U0001f600‍\U0001f600 漢字かな", "ß ẞ Ÿ ÷ ×"]


def test_pack(spark):
    from tokenizers import Tokenizer

    texts = [*EDGES, *ODD, prose(1, 5000), prose(2, 900), prose(2, 900), "x " * 700_000]
    library = Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    want = sorted((i, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for i, x in enumerate(ids) for k, start in enumerate(range(0, len(x), 300)) for own in [x[start : start + 300]])
    rows = packing.pack(docs(spark, *texts).repartition(3), length=300).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert fills((r.sequence_id, r.offset, r.length) for r in rows) == packing.brute_plan([w[3] for w in want], 300)


def test_pack_rows_of_one_or_no_id(spark):
    d = docs(spark, "a b", "a b", None).withColumn("doc_id", F.lit(None).cast("long"))
    rows = packing.pack(d).collect()
    assert len(rows) == 3 and fills((r.sequence_id, r.offset, r.length) for r in rows) == [7]
    assert packing.pack(d.where("false")).count() == 0


# 13


def brute_audit(rows, least=3, most=200):
    """(lang, source, part, item, value, rank) of rows (lang, source, text), term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    groups, count, df = {r[:2] for r in rows}, {}, {}
    for lang, source, text in rows:
        words = [w.decode() for w in audit.words_of(text.encode())]
        for w in words:
            count[lang, source, w] = count.get((lang, source, w), 0) + 1
        for w in set(words):
            df[lang, w] = df.get((lang, w), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = [w for (x, w), n in df.items() if x == lang and n >= least], sorted(s for x, s in groups if x == lang)
        c = {s: {w: count.get((lang, s, w), 0) for w in kept} for s in sources}
        c[None] = {w: sum(c[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 10**9 * (n + 1) // (sum(x.values()) + len(kept)) for w, n in x.items()} for s, x in c.items()}
        for s in sources:
            f = lambda w, other: (p[s][w] - p[other][w]) ** 2 // p[other][w]
            found = [("pair", o, sum(f(w, o) for w in kept)) for o in sources if o != s]
            terms = sorted((("term", w, f(w, None)) for w in kept if c[s][w] and p[s][w] > p[None][w]), key=lambda x: (-x[2], x[1].encode()))[:most]
            for part in (sorted(found, key=lambda x: (-x[2], x[1].encode())), terms):
                out += [(lang, s, *x, rank) for rank, x in enumerate(part, 1)]
    return sorted(out)


def audited(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, source string, text string").select("*", *(F.lit("clash").alias(c) for c in CLASH))
    return sorted(tuple(r) for r in audit.divergences(df.repartition(3), **more).collect())


def test_audit(spark):
    rng = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "é", "漢字", "Zz"]
    rows = [(rng.choice(["en", "de", None]), rng.choice([*"abcdefghijk", "é", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", "a", "common " * 5000)] * 40 + [("fr", "x", "only here"), ("fr", "y", None), ("fr", "z", ""), ("", "", "A1b-c")]
    assert audited(spark, rows) == brute_audit(rows)
    assert audited(spark, rows, most=3) == brute_audit(rows, most=3)


def test_audit_of_rare_terms_among_many_sources(spark):
    """Most terms are in a few of 60 sources, so that corrections from postings decide."""
    rng = random.Random(10)
    rows = [("en", f"s{i % 60:02}", " ".join("q" + chr(97 + rng.randint(0, 25)) + chr(97 + rng.randint(0, 25)) for _ in range(12)) + " the" * (i % 7)) for i in range(240)]
    assert audited(spark, rows) == brute_audit(rows)


def test_pair_sums_by_blocks():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 3, 9, 1, 5, 2])
    at = np.concatenate([np.sort(rng.choice(11, k, replace=False)) for k in sizes])
    count = rng.integers(1, 9, len(at))
    whole = rng.integers(90, 200, 11)
    p, absent = audit.share(count, whole[at]), audit.share(np.zeros(11, np.int64), whole)
    every = audit._pair_sums(0, 11, sizes, at, p, absent, count)
    assert (np.concatenate([audit._pair_sums(a, min(11, a + 4), sizes, at, p, absent, count) for a in (0, 4, 8)]) == every).all()
    table = np.tile(absent, (len(sizes), 1))
    table[np.repeat(np.arange(len(sizes)), sizes), at] = p
    want = [[sum((int(r[g]) - int(r[h])) ** 2 // int(r[h]) for r in table) for h in range(11)] for g in range(11)]
    assert (every + np.diag(np.diag(-every))).tolist() == want


def test_share_is_exact():
    for count, total in [(0, 1), (5, 7), (10**12, 3 * 10**14), (10**15, 10**15 + 7)]:
        assert int(audit.share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


def test_audit_of_nothing(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("en", "a", "x y"), ("en", "b", None), (None, None, None)]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# 10, 8


def test_scores_of_odd_ids_and_texts_of_megabytes(spark):
    d = docs(spark, "a b c", "a b c", "x y " * 600_000, None, "").withColumn("doc_id", F.when(F.col("doc_id") > 1, F.lit(7)).cast("long"))
    labels = spark.createDataFrame([(7, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        rows = module.score(d, labels).collect()
        assert len(rows) == 5 and [r.doc_id for r in rows].count(None) == 2 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert len({r.score for r in rows if r.doc_id is None}) == 1
