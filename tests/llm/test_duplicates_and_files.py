"""Near duplicates, token files and the pipeline against plain versions."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from lotframe.llm import near_duplicates as near
from lotframe.llm import token_files as files
from lotframe.llm.components import components

from test_text_operators import WORD, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")


def union(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


# ---- components ------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (300, 301), (301, 300)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == union({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 9 SimHash -------------------------------------------------------------------


def plain_fingerprint(text, n):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(spark, documents):
    base = prose(400, 21)
    rows = [(i, prose(5 + i, i)) for i in range(10, 90)]
    for i in range(40):
        words = base.split()
        words[i * 9] = "other"
        rows.append((200 + i, " ".join(words)))
    rows += [(1, None), (500, ""), (501, " \n"), (502, "One É"), (503, "one É"), (503, "one É"), (None, base), (504, base), (505, "K K K K")]
    found = near.near_duplicate_components(documents(rows, ", fp long, point int", (1, 2)), shingle_words=3).collect()
    prints = {(i, plain_fingerprint(t, 3)) for i, t in rows}
    assert {(r.doc_id, r.fp % (1 << 64)) for r in found} == prints and len(found) == len(rows)
    values = sorted({f for _, f in prints})
    roots = union(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    least = collections.defaultdict(list)
    for i, f in prints:
        least[roots[f]] += [i] if i is not None else []
    assert all(r.component_id == min(least[roots[r.fp % (1 << 64)]]) for r in found)
    assert near.near_duplicate_components(documents([]), 3).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_vantage_tree_finds_every_link(spark, monkeypatch, seed):
    monkeypatch.setattr(near, "LEAF_SAMPLE", 8)
    monkeypatch.setattr(near, "BLOCK_PAIRS", 4096)
    rng = np.random.default_rng(seed)
    centres = rng.integers(-(2**63), 2**63 - 1, 300)
    points = [centres]
    for flips in (1, 2, 2, 3):
        moved = centres.copy()
        for _ in range(flips):
            moved ^= np.int64(1) << rng.integers(0, 63, len(moved))
        points.append(moved)
    points = np.unique(np.concatenate(points))
    links = near.fingerprint_links(spark.createDataFrame([(int(p),) for p in points], "fp long")).collect()
    found = union(points.tolist(), [(r.u, r.v) for r in links])
    apart = np.bitwise_count((points[:, None] ^ points[None, :]).view(np.uint64))
    expected = union(points.tolist(), [(int(points[i]), int(points[j])) for i, j in zip(*np.nonzero(apart <= 2)) if i < j])
    assert found == expected and len(set(expected.values())) < len(points)


def test_one_document_of_each_component_stays(spark, documents):
    rows, family = [], {}
    for f in range(8):
        base = prose(900, 50 + f)
        for k in range(4 if f else 30):
            rows.append((len(rows), base + " " * k if k % 2 else base.replace(" ", "  ")))
            family[len(rows) - 1] = f
    rows += [(1000 + i, prose(240, 900 + i)) for i in range(40)] + [(2000, None), (2001, ""), (3000, "long " * 40_000)]
    found = {r.doc_id: r.component_id for r in near.near_duplicate_components(documents(rows)).collect()}
    assert all(found[i] == min(j for j, g in family.items() if g == f) for i, f in family.items())
    assert all(found[1000 + i] == 1000 + i for i in range(40)) and found[2001] == 2000 and found[3000] == 3000
    docs = documents([*rows, rows[0], (None, "x y"), (None, rows[0][1])])
    kept = near.one_per_component(docs, near.near_duplicate_components(docs))
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter({**{i: 1 for i in set(found.values())}, None: 2}) and kept.columns == docs.columns


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(near, "SAMPLE_LEAST", 50)
    monkeypatch.setattr(near, "SAMPLE_MOST", 60)
    seen = []
    plain = near.vantage_tree
    monkeypatch.setattr(near, "vantage_tree", lambda points, leaf: seen.append(points) or plain(points, leaf))
    points = spark.range(5000).select(F.xxhash64("id").alias("fp"))
    near.fingerprint_links(points)
    assert 20 < len(seen[0]) < 120 and (np.diff(seen[0]) > 0).all()


# ---- 5 token files ---------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    rng = random.Random(5)
    alphabet = ["a", "Z", "1", " ", "  ", "\n", "\t", "é", "漢", "'s", "don't", ".", " ", "　", "\x1c", "\x85", "<|endoftext|>", "##", "🙂", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(1500)]
    plain = Tokenizer.from_file(BPE)
    tool = files.Encoder(BPE)
    for text, raw in zip(texts, tool.encode(texts)):
        assert np.frombuffer(raw, tool.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


class Counted:
    """Passes everything on and notes the calls."""

    def __init__(self, inner, calls):
        self.inner, self.calls = inner, calls

    def __getattr__(self, name):
        value = getattr(self.inner, name)
        if not callable(value):
            return value
        return lambda *args, **kwargs: self.calls.append(name) or value(*args, **kwargs)


def test_new_words_go_to_the_library_together():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäé", k=rng.randint(7, 12))) for _ in range(20_000)]
    texts = ["".join(w + rng.choice([" ", ", ", ".\n"]) for w in words[i : i + 500]) for i in range(0, len(words), 500)]
    tool, calls = files.Encoder(BPE), []
    tool.model, tool.tokenizer = Counted(tool.model, calls), Counted(tool.tokenizer, calls)
    found = tool.encode(texts)
    assert 0 < len(calls) < 100
    plain = Tokenizer.from_file(BPE)
    assert [np.frombuffer(raw, tool.kind).tolist() for raw in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_what_is_remembered_is_bounded(monkeypatch):
    for name, value in (("PORTION", 5), ("WORDS_A_CALL", 3), ("MEMO_BYTES", 400)):
        monkeypatch.setattr(files, name, value)
    rng = random.Random(7)
    pieces = ["a", "b.", "c'll", "d\né", "漢", "e漢f", "12x", "ԯ", "԰", "\x00", "ÿ", "..", "long" * 200]
    texts = ["", "one", " ", "a ", " a", "a b\n", *(" ".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(400))]
    plain, tool = Tokenizer.from_file(BPE), files.Encoder(BPE)
    assert tool.encode([]) == [] and all(tool._may_be_cut(text) for text in texts)
    for at in range(0, len(texts), 20):
        for text, raw in zip(texts[at : at + 20], tool.encode(texts[at : at + 20]), strict=True):
            assert np.frombuffer(raw, tool.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
        assert all(m.keys.nbytes + m.known.nbytes <= 400 for m in (tool.memo, tool.words))


def test_tokenizers_that_do_not_spell_every_byte(tmp_path):
    odd = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "Ġ": 3, "Ġab": 4}, [("a", "b"), ("Ġ", "ab")]))
    odd.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    odd.save(str(tmp_path / "odd.json"))
    tool, texts = files.Encoder(str(tmp_path / "odd.json")), ["ab ab cab", "x", "b xaby ab", ""]
    assert [np.frombuffer(raw, tool.kind).tolist() for raw in tool.encode(texts)] == [odd.encode(t).ids for t in texts]


def test_files_round_trip(spark, tables, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PACK_IDS", 3000)
    plain = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    odd = documents([(None, "no id"), (-5, None), (10**6, ""), (10**6 + 1, "x " * 30_000), (10**6 + 2, "same"), (10**6 + 2, "same")]).select("doc_id", "text")
    path = str(tmp_path / "t")
    files.write_token_files(docs.unionByName(odd).withColumn("part", F.lit(1)), path, BPE)
    found = files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    rows = sorted(docs.unionByName(odd).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for got, row in zip(found, rows, strict=True):
        ids = plain.encode(row.text or "", add_special_tokens=False).ids + [0]
        assert (got.doc_id, got.start, got.n_tokens, got.ids) == (row.doc_id, start, len(ids), ids)
        assert got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = {r.doc_id: r.ids for r in files.read_documents(spark, path, [3, 7, 10**6, 99_999_999]).collect()}
    assert some == {r.doc_id: r.ids for r in found if r.doc_id in (3, 7, 10**6)}
    assert spark.read.parquet(f"{path}/packs").count() > 3
    dictionary = files._dictionary(spark, path)
    assert dictionary
    body = spark.read.parquet(f"{path}/packs").first().body
    with pytest.raises(ValueError):
        files.Pack(bytes(body), dictionary + b"x")


def test_small_and_empty_tables(spark, documents, tmp_path):
    files.write_token_files(documents([(1, "only one")]), str(tmp_path / "a"), BPE)
    assert [(r.doc_id, r.start) for r in files.read_token_files(spark, str(tmp_path / "a")).collect()] == [(1, 0)]
    files.write_token_files(documents([]), str(tmp_path / "b"), BPE)
    assert files.read_token_files(spark, str(tmp_path / "b")).collect() == []


# ---- pipeline --------------------------------------------------------------------


def test_pipeline_keeps_clean_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    quality = spark.createDataFrame(corpus_pipeline.quality_rules(spark, docs, tables).collect(), docs.schema)
    distinct = spark.createDataFrame(corpus_pipeline.near_duplicates(spark, quality, tables).collect(), docs.schema)
    clean = spark.createDataFrame(corpus_pipeline.decontamination(spark, distinct, tables).collect(), docs.schema)
    rows = {name: {r.doc_id: r.text for r in df.collect()} for name, df in (("q", quality), ("d", distinct), ("c", clean))}
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    assert set(rows["d"].values()) <= set(rows["q"].values()) and len(set(rows["d"].values())) == len(rows["d"])
    prints = {i: plain_fingerprint(t, 3) for i, t in rows["q"].items()}
    ids = sorted(prints)
    roots = union(ids, [(i, j) for i in ids for j in ids if i < j and (prints[i] ^ prints[j]).bit_count() <= 2])
    assert rows["d"].keys() == set(roots.values())
    assert rows["d"].keys() - rows["c"].keys() == {i for i, t in rows["d"].items() if any(x in t for x in items)}
    mixed = corpus_pipeline.source_mix(spark, clean, tables)
    assert mixed.columns == docs.columns
    mixed_rows = mixed.collect()
    count = collections.Counter(r.doc_id for r in mixed_rows)
    assert max(count.values()) <= 3 and set(count) <= set(rows["c"])
    assert all(set(WORD.findall(r.text)) <= set(WORD.findall(rows["c"][r.doc_id])) and r.n_chars == len(r.text) for r in mixed_rows)
    mixed = spark.createDataFrame(mixed_rows, docs.schema)
    final = corpus_pipeline.token_files(spark, mixed, tables).collect()
    assert collections.Counter(r.doc_id for r in final) == count
    plain = Tokenizer.from_file(BPE)
    assert sum(r.n_tokens for r in final) == sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed_rows)


def test_pipeline_of_an_empty_table(spark, tmp_path, documents):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "decontamination", "source mix", "token files",
    ]
