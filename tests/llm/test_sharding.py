import collections
import zlib

from pyspark.sql import functions as F

from lotframe.llm.sharding import hilbert_index, hilbert_shards, op8_hilbert_shards, write_shards


def test_curve_is_a_path_through_all_cells(spark):
    cells = spark.range(512).selectExpr("id % 8 a", "id div 8 % 8 b", "id div 64 c")
    found = hilbert_index(cells, ["a", "b", "c"], 3, "h").orderBy("h").collect()
    assert [r.h for r in found] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p[:3], q[:3])) == 1 for p, q in zip(found, found[1:]))


def test_rows_differ_by_one_and_slots_have_no_gaps(spark, tables):
    found = op8_hilbert_shards(spark, tables).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert sorted(r.doc_id for r in found) == sorted(texts) and len(slots) == 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1


def test_odd_rows_and_files(spark, documents, tmp_path):
    rows = [(1, None), (None, "a", None, "s"), (2, "", "en", None), (3, "x" * 50_000, "en", "s"), (4, "b", "de", "t"), (4, "b", "de", "t")]
    docs = documents(rows, ", shard string, _local int", ("old", 1))
    found = hilbert_shards(docs, n_shards=4).collect()
    assert sorted(collections.Counter(r.shard for r in found).values()) == [1, 1, 2, 2]
    assert all(r._local == 1 for r in found)
    write_shards(docs.drop("shard"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and back.select(F.countDistinct("shard")).first()[0] == 4
    assert hilbert_shards(documents([])).collect() == []
