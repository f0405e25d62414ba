import collections

import pytest
from pyspark.sql import functions as F

from lotframe.llm.mixing import Mix, permuted, targets


def level_targets(sizes, weights):
    """Shares by weight; what a cap leaves is shared again, until no target is above its cap."""
    left, out = dict(enumerate(sizes)), {}
    rest = sum(sizes)
    while left:
        level = rest / sum(weights[i] for i in left)
        above = [i for i in left if level * weights[i] > 3 * sizes[i]]
        if not above:
            return [out[i] if i in out else level * weights[i] for i in range(len(sizes))]
        for i in above:
            out[i] = 3 * left.pop(i)
            rest -= out[i]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1, 1, 1000, 5], [0, 10, 10], [7], [0, 0], [5, 50, 500, 5000, 50000]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    found = targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy("source").collect()
    assert [r.weight for r in found] == [i % 3 + 1 for i in range(len(sizes))]
    expected = level_targets(sizes, [i % 3 + 1 for i in range(len(sizes))]) if sum(sizes) else [0.0] * len(sizes)
    assert [r.target for r in found] == pytest.approx(expected)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
    found = [r.out for r in permuted(df, "id", "n", [F.lit(5)], "out").orderBy("id").collect()]
    assert sorted(found) == list(range(n))
    assert n < 100 or found != list(range(n))


def test_mix_of_a_hot_and_small_sources(spark, documents):
    words = [f"w{i}" for i in range(40_000)]
    rows = [(i, " ".join(words[i * 300 : i * 300 + 300]), "en", "hot") for i in range(100)]
    rows += [(200 + i, " ".join(words[i * 90 : i * 90 + 90]), "en", "small") for i in range(30)] + [(300, "a b c", "en", None)]
    rows += [(301, None, "en", "hot"), (302, "", "en", "empty"), (303, " \t ", None, "empty"), (304, "x y", "en", "hot"), (304, "x y", "en", "hot")]
    docs = documents(rows, ", chunk int, src string, block long", (1, "s", 2))
    mix = Mix(docs, block_words=16, shard_slots=64)
    found = mix.taken().collect()
    assert len(found) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == {"hot": 30_004, "small": 2_700, None: 3, "empty": 0}[r.source]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    # Code point order, null last: empty 1, hot 2, small 3, null 1.
    assert target["small"] == 8_100 and target[None] == 9 and target["empty"] == 0
    for source in ("hot", "small", None):
        assert abs(taken[source] - target[source]) <= 48
    again = Mix(docs, block_words=16, shard_slots=64).taken().collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_slots_and_texts(spark, documents):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(50 + i)), "en", "ab"[i % 2]) for i in range(20)]
    mix = Mix(documents(rows), block_words=16, shard_slots=10)
    pieces = mix.pieces.collect()
    slots = {(r.shard, r.slot) for r in pieces}
    assert slots == {(i // 10, i % 10) for i in range(len(slots))}
    assert len({(r.src, r.block, r.pass_no) for r in pieces}) == len(slots)
    texts = mix.texts().collect()
    words = collections.Counter(w for r in texts for w in r.text.split())
    by_doc = collections.Counter()
    for r in pieces:
        by_doc[r.doc_id] += r.n_words
        for j in range(r.first_word, r.first_word + r.n_words):
            words[f"d{r.doc_id}w{j}"] -= 1
    assert not +words and not -words
    assert by_doc == {r.doc_id: r.taken for r in mix.taken().collect() if r.taken}


def test_empty_table(spark, documents):
    mix = Mix(documents([]))
    assert mix.taken().collect() == [] and mix.texts().collect() == []
