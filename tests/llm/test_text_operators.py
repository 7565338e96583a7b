"""The operators on documents against plain brute force, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import jaccard, licenses, mixing, packing, substrings, token_counts, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def in_duckdb(sql, texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, ("a", "b", None)[i % 3]) for i, t in enumerate(texts)])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(tuple(zip(names, r)) for r in found.fetchall())


def as_rows(df):
    return sorted(tuple((c, r[c]) for c in df.columns) for r in df.collect())


def test_mixing_matches_sql(docs, texts):
    found = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
    want = [dict(r) for r in in_duckdb(mixing.MIX_SQL, texts)]
    assert sorted([dict(r) for r in as_rows(found)], key=lambda r: r["doc_id"]) == sorted(want, key=lambda r: r["doc_id"])


def test_mixing_keeps_its_limits(docs):
    rows = mixing.mix_sources(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6


def test_mixed_rows(docs, odd):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    got = collections.Counter(r["doc_id"] for r in mixing.mixed(docs).select("doc_id").collect())
    assert got == {k: v for k, v in plan.items() if v}
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(odd).count() == mixing.mix_sources(odd).agg(F.sum("copies")).first()[0]


def brute_groups(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORDS.findall(t or "")]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and (both := len(sets[i] & sets[j])) and 100 * both >= percent * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(5, 80)])
def test_jaccard_groups(docs, texts, rule):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, rule=rule).collect()}
    assert found == brute_groups(texts, rule.n, rule.percent)


def test_groups_in_sql(texts):
    found = {dict(r)["doc_id"]: (dict(r)["n_shingles"], dict(r)["component_id"]) for r in in_duckdb(jaccard.GROUPS_SQL, texts)}
    assert found == brute_groups(texts, 4, 85)


def test_long_lists_are_compared_in_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 2)
    monkeypatch.setattr(jaccard, "PART_SETS", 5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs).collect()}
    assert found == brute_groups(texts, 4, 85)


def test_groups_at_the_threshold(spark):
    """Copies of copies with ever more changes: many pairs just above and just below the threshold."""
    rnd = random.Random(11)
    texts = []
    for _ in range(4):
        base = [f"v{rnd.randrange(300)}" for _ in range(rnd.choice((12, 60, 150)))]
        for _ in range(25):
            words = list(rnd.choice((base, texts[-1].split())) if texts else base)
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(9)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for rule in (jaccard.Rule(), jaccard.Rule(5, 80), jaccard.Rule(2, 60)):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, rule=rule).collect()}
        assert found == brute_groups(texts, rule.n, rule.percent)


def test_groups_of_text_ids(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), ("c", "six")]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {("a", "a"), ("b", "a"), ("c", "c")}


@pytest.mark.parametrize("second", [7, (5 << 32) + 7, -1])
def test_sets_with_like_names_are_two(second):
    """Two sets of 100 n-grams that differ in one share 99 each, whatever of their names is equal; one sent twice shares none."""
    import pyarrow as pa

    first, grams = (3 << 32) + 7, np.arange(100, 200)
    both = [(first, grams), (second, np.r_[grams[:-1], 500])]
    row = lambda part, name, g: {"part": part, "owners": np.array([name], dtype="<i8").tobytes(), "counts": jaccard.pack(np.array([100])), "grams": g.astype("<u4").tobytes()}
    found = jaccard._shared(pa.Table.from_pylist([row(k, *x) for k, x in enumerate(both)]))
    assert [jaccard.unpack(x).tolist() for x in found.column("sums").to_pylist()] == [[99], [99]]
    twice = jaccard._shared(pa.Table.from_pylist([row(k, *both[0]) for k in range(2)]))
    assert [len(x) for x in twice.column("owners").to_pylist()] == [0, 0]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 150, 400, 2000]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[rng.permutation(a)[rng.integers(0, n) :], rng.integers(0, 1 << 63, rng.integers(1, n + 1), dtype=np.uint64)])
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        words = min(len(x), len(y))
        assert np.bitwise_count(jaccard.folded(x, words) ^ jaccard.folded(y, words)).sum() <= len(np.setxor1d(a, b))


def test_a_large_group_of_near_copies_makes_linear_rows(spark, monkeypatch):
    """20,000 near copies, all different: no table that is written has more than a bounded number of rows for each."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "), F.lit(" end"), F.col("id").cast("string")).alias("text"))
    made, written = {}, jaccard.written

    def counted(df, label):
        out = written(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    found = jaccard.jaccard_groups(rows).agg(F.count("*"), F.max("component_id"), F.countDistinct("component_id")).first()
    assert tuple(found) == (20_000, 0, 1)
    assert max(made.values()) <= 20_000 * 30, made


def test_substrings_match_sql(docs, texts):
    found = substrings.digest(substrings.dedup_substrings(docs))
    assert as_rows(found) == in_duckdb(substrings.WINDOW_SQL, texts)


def test_substrings_in_many_batches(docs, texts):
    found = substrings.digest(substrings.dedup_substrings(docs, settings=substrings.Settings(batches=5, filter_bits=1 << 20)))
    assert as_rows(found) == in_duckdb(substrings.WINDOW_SQL, texts)


def test_substrings_by_rank_of_odd_ids(docs, texts):
    moved = docs.withColumn("doc_id", F.col("doc_id") - 40)
    found = substrings.digest(substrings.dedup_substrings(moved)).withColumn("doc_id", F.col("doc_id") + 40)
    assert as_rows(found) == in_duckdb(substrings.WINDOW_SQL, texts)


def test_index_takes_batches_one_by_one(spark, docs, texts):
    index = substrings.SubstringIndex(spark, substrings.Settings(max_runs=2))
    numbered = docs.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    found = []
    for low, high in ((0, 10), (10, 20), (20, 30), (30, 1000)):
        found += as_rows(substrings.digest(index.add(numbered.filter(f"doc >= {low} AND doc < {high}"))))
        assert len(index.prints) <= 2 and len(index.windows) <= 2
    assert sorted(found) == in_duckdb(substrings.WINDOW_SQL, texts)
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name in index._names]


def test_a_saved_index_takes_further_batches(spark, docs, texts, tmp_path):
    numbered = docs.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    index, found = substrings.SubstringIndex(spark), []
    for low, high in ((0, 10), (10, 20)):
        found += as_rows(substrings.digest(index.add(numbered.filter(f"doc >= {low} AND doc < {high}"))))
    index.save(str(tmp_path / "manifest"))
    index.close()
    again = substrings.SubstringIndex.open(spark, str(tmp_path / "manifest"), numbered.filter("doc < 20"))
    assert (len(again.prints), len(again.windows)) == (2, 2)
    for low, high in ((20, 30), (30, 1000)):
        found += as_rows(substrings.digest(again.add(numbered.filter(f"doc >= {low} AND doc < {high}"))))
    again.close()
    assert sorted(found) == in_duckdb(substrings.WINDOW_SQL, texts)


def test_dedup_leaves_no_tables(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    substrings.dedup_substrings(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_license_base_columns_match_sql(docs, texts):
    found = licenses.scan(docs)
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted(map(str, as_rows(found.select(*columns)))) == sorted(map(str, in_duckdb(licenses.BASE_SQL, texts)))
    for r in found.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def brute_scan(text):
    """labels, score and spans of a text, span by span."""
    cut = lambda x: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    words, labels, best, spans = cut(text or ""), set(), 0.0, 0
    for phrase, label, base in [*((p, x, True) for p, x in licenses.BASE.items()), *((p, x, False) for p, x in licenses.NOTICES)]:
        own, k = cut(phrase), 2 if base else 3
        by = collections.defaultdict(set)
        for p in range(len(words) - k + 1):
            for q in range(len(own) - k + 1):
                if words[p : p + k] == own[q : q + k]:
                    by[p - q].add(q)
        whole, groups = len(own) - k + 1, []
        for d in sorted(by):
            if groups and not base and d - groups[-1][-1] <= 2 and len(by[d]) < whole and len(by[groups[-1][-1]]) < whole:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            places = set().union(*(by[d] for d in g))
            share = len({q + j for q in places for j in range(k)}) / len(own)
            best = max(best, share)
            if len(places) == whole if base else share >= 0.8:
                labels.add(label)
                spans += 1
    return ",".join(sorted(labels)), best, spans


def test_license_labels_match_brute_force(spark):
    rnd, texts = random.Random(8), [None, "", "cc", "gnu lesser"]
    notices = [x for x, _ in licenses.NOTICES]
    for _ in range(120):
        words = []
        for _ in range(rnd.randrange(1, 4)):
            own = rnd.choice(notices).split()
            for _ in range(rnd.randrange(4)):
                k = rnd.randrange(len(own) + 1)
                own[k : k + rnd.randrange(2)] = [rnd.choice(("", "very", "the", "License"))]
            words += [rnd.choice(("a", "text", "of the"))] * rnd.randrange(3) + own
        texts.append(" ".join(words))
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: (r["labels"], r["score"], r["n_spans"]) for r in found.collect()}
    for i, t in enumerate(texts):
        labels, score, spans = brute_scan(t)
        assert (got[i][0], got[i][2]) == (labels, spans) and abs(got[i][1] - score) < 1e-12, t


def test_license_templates_are_a_table(spark):
    own = spark.createDataFrame([("for internal use by staff only", "internal", False)], "text string, label string, base boolean")
    row = licenses.scan(spark.createDataFrame([(1, "This is for internal use, by staff only!")], "doc_id long, text string"), templates=own).first()
    assert (row["labels"], row["score"], row["n_base"]) == ("internal", 1.0, 0)


def test_license_notices_with_an_added_word(spark):
    text = "it is licensed under the very same apache license and licensed under the apache license"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "apache-notice" and row["score"] == 1.0 and row["n_base"] == 0


def test_token_counts(docs, texts):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    rows = token_counts.count_tokens(docs, BYTE_BPE).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)


def test_packing(docs, texts):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(docs, WORD_BPE).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(range(len(texts)))
    for i, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= sum(r["length"] for r in rows) / 4096 + 2


def test_packed_ids(docs):
    rows = packing.pack(docs, WORD_BPE, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)


def test_sum_of_squares_prefers_perfect_fits():
    bins, offsets, fill = packing.sum_of_squares(np.array([6, 5, 4, 5, 10, 0 + 3]), 10)
    assert sorted(fill.tolist()) == [3, 10, 10, 10] and offsets[2] == 6 and bins[3] == bins[1]


@pytest.mark.parametrize("kind", ["uniform", "short", "halves"])
def test_packing_comes_near_the_bound(kind):
    rng = np.random.default_rng(6)
    lengths = {"uniform": rng.integers(2, 4095, 20_000), "short": np.minimum(rng.exponential(400, 20_000).astype(np.int64) + 1, 4095), "halves": rng.integers(1900, 2300, 5_000)}[kind]
    lengths = np.sort(lengths)[::-1]
    bins, offsets, fill = packing.repaired(lengths, *packing.sum_of_squares(lengths))
    least = max(-(-lengths.sum() // 4096), (lengths > 2048).sum() + -(-(lengths == 2048).sum() // 2))
    assert len(fill) <= 1.01 * least + 1
    assert (np.bincount(bins, weights=lengths, minlength=len(fill)) == fill).all() and fill.max() <= 4096
    order = np.lexsort((offsets, bins))
    ends = (offsets + lengths)[order]
    assert all(offsets[j] == (ends[k - 1] if k and bins[j] == bins[order[k - 1]] else 0) for k, j in enumerate(order))


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        group = "women" if i % 8 == 0 else "men" if i % 5 == 0 else "people"
        rows.append((i, f"the {group} of town {i % 7} {'are idiots and worthless' if bad else 'met in may'} number {i % 11}"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in found)


def test_counterfactuals_lower_what_a_group_mention_adds(spark):
    docs, labels = labelled(spark)
    known = labels.withColumnRenamed("toxic", "label")
    gap = {}
    for weight in (0.0, 20.0):
        model = toxicity.fit(docs, known, settings=toxicity.Settings(fairness=weight))
        a, b = next(model.score(iter([["the women met in may", "the men met in may"]])))
        gap[weight] = abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))
    assert gap[20.0] < 0.5 * gap[0.0]


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, none).collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows}) == 1 and not any(r["predicted"] for r in rows)


def test_toxicity_on_held_out_documents(spark):
    """Held-out rows of the given tables: the score orders them, and few clean ones are predicted."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).filter("held_out").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    bad, good = [np.array([r["score"] for r in rows if r["toxic"] == k]) for k in (1, 0)]
    order = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert order > 0.85 and (good >= 0.7).mean() < 0.05  # some 600 labels to learn from


def test_pipeline_stages_match_brute_force(spark, docs, texts):
    import corpus_pipeline

    labels = brute_groups(texts, 5, 80)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert kept == {i: t for i, t in enumerate(texts) if labels[i][1] == i}
    # words of windows of 20 that start earlier, one document after the other
    seen, want = set(), {}
    for i in sorted(kept):
        words = WORDS.findall(kept[i] or "")
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        if not gone:
            want[i] = kept[i]
        elif len(gone) < len(words):
            want[i] = " ".join(w for k, w in enumerate(words) if k not in gone)
    found = corpus_pipeline.drop_repeats(spark, left, "")
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want


OPERATORS = {
    "mix": lambda d: mixing.mix_sources(d),
    "pack": lambda d: packing.pack(d, WORD_BPE),
    "scan": lambda d: licenses.scan(d),
    "count": lambda d: token_counts.count_tokens(d, BYTE_BPE),
    "groups": lambda d: jaccard.jaccard_groups(d),
    "dedup": lambda d: substrings.digest(substrings.dedup_substrings(d)),
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(0).alias("toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, empty):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_null_ids_and_clashing_columns(name, odd):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) == odd.count()
    assert collections.Counter(r["doc_id"] for r in rows) == {1: 2, None: 2, 2: 1, 3: 1}


def test_groups_of_odd_rows(odd):
    rows = jaccard.jaccard_groups(odd).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (None, None), (2, 2), (3, 1)}


def test_sha_of_nothing(spark):
    row = substrings.digest(substrings.dedup_substrings(spark.createDataFrame([(1, None)], "doc_id long, text string"))).first()
    assert row["kept_sha256"] == hashlib.sha256(b"").hexdigest() and row["n_words"] == row["n_removed"] == 0


def test_encoder_equals_the_tokenizer():
    from sparkloom.llm.tokenizing import ChunkEncoder

    tokenizer, encoder = Tokenizer.from_file(WORD_BPE), ChunkEncoder(WORD_BPE)
    rng = np.random.default_rng(4)
    letters = "abzAZ09 '\t\n\r\x0b\x0c\x1c\x1f\x85\xa0.,;!<|>_-sdtmÀÖ×Øöø÷ßẞÿĀİıŉɏɐééñÇΣσς²½Ⅷ日本 ّ​　ﬁ"
    words = ["it's", "we'll", "I'VE", "<|endoftext|>", "<|startoftext|>x", "ÉLAN", "naïve", "DŽ", "ǅ"]
    texts = ["".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(1, 40))) for _ in range(4000)]
    texts += [" ".join(words[i] for i in rng.integers(0, len(words), 5)) for _ in range(50)] + [c for c in map(chr, range(1, 0x260))]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
