"""Periodic runs, spelling variants and line removal against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lotframe.llm.line_dedup import (
    ORACLE_SQL,
    PerfectHash,
    Shard,
    common_keys,
    hashed_lines,
    line_index,
    op13_line_dedup,
    shard_arrays,
    without_common_lines,
)
from lotframe.llm.periodic_runs import find_runs, kept_words, op11_periodic_runs, split_by_frequency, with_runs
from lotframe.llm.spelling import counted, neighbour_summaries, occurrences, op12_permuterm_variants, spelling_groups

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def plain_words(text):
    return [w for w in SPACES.split(text or "") if w]


def plain_runs(words, least=12):
    """Every (start, length, period), by comparing all words at all lags."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            i = j
            if length < max(least, 2 * q):
                continue
            part = words[start : start + length]
            if not any(part[d:] == part[: length - d] for d in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_periodic(rows):
    out = {}
    for doc_id, text in rows:
        words = plain_words(text)
        n = len(words)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        keep = [not any(s + q <= i < s + length for s, length, q in runs) for i in range(n)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        out[doc_id] = (
            len(runs),
            *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for w, k in zip(words, keep) if k)),
        )
    return out


def sequences(seed):
    rng = random.Random(seed)
    yield []
    yield ["a"] * 11
    yield ["a"] * 12
    yield ["a"] * 300
    yield list("ababababababab")
    yield list("abcabcabcabcabcabcabcabdabdabdabdabd")
    for letters, most in ((1, 40), (2, 60), (2, 200), (3, 120), (5, 150), (40, 200)):
        for _ in range(12):
            yield [str(rng.randrange(letters)) for _ in range(rng.randrange(most))]
    for _ in range(60):
        block = [str(rng.randrange(rng.choice((2, 4, 30)))) for _ in range(rng.randrange(1, 40))]
        times = rng.randrange(2, 9)
        inner = block * times + block[: rng.randrange(len(block) + 1)]
        around = [str(rng.randrange(50)) for _ in range(rng.randrange(30))]
        text = around + inner + around[::-1] + inner[: rng.randrange(len(inner) + 1)]
        yield text * rng.choice((1, 1, 2, 3))
    fibonacci, before = ["a", "b"], ["a"]
    while len(fibonacci) < 400:
        fibonacci, before = fibonacci + before, fibonacci
    yield fibonacci
    yield [str(bin(i).count("1") % 2) for i in range(700)]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_are_those_of_all_lags(seed):
    docs = list(sequences(seed))
    kinds = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    word = np.array([kinds[w] * 7919 for d in docs for w in d], np.uint64)
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    found = find_runs(word, first)
    for i, words in enumerate(docs):
        assert [tuple(r) for r in found.get(i, np.zeros((0, 3))).tolist()] == plain_runs(words), words
    alone = {i: find_runs(word[a:b], np.array([0, b - a])) for i, (a, b) in enumerate(zip(first, first[1:])) if i % 7 == 0}
    assert all(np.array_equal(alone[i].get(0, 0), found.get(i, 0)) for i in alone)


def test_frequency_splitting_recurses():
    # "x" is alone at first; of its two sides only one still has "b" twice, and so on.
    words = list("ababxaabbcc")
    begin, end = split_by_frequency(np.array([ord(c) for c in words]), np.array([0]), np.array([len(words)]), 2)
    assert list(zip(begin.tolist(), end.tolist())) == [(0, 4), (5, 11)]
    words = list("abcadbeba")  # c, d and e go, then what is alone in its piece, until nothing is left
    assert not len(split_by_frequency(np.array([ord(c) for c in words]), np.array([0]), np.array([9]), 2)[0])


def test_a_long_document_takes_no_quadratic_work():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 1000, 100_000)
    word = np.concatenate((block, block, block[:70_000], rng.integers(0, 1000, 200_000), np.zeros(50_000, np.int64)))
    found = find_runs(word, np.array([0, len(word)]))
    assert [tuple(r) for r in found[0].tolist() if r[2] > 1] == [(0, 270_000, 100_000)]
    assert [r[1] >= 50_000 for r in found[0].tolist() if r[2] == 1] == [True]


def test_kept_words():
    assert kept_words(8, np.array([[1, 6, 2]])).tolist() == [True, True, True, False, False, False, False, True]


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a " * 30), (5, "a " * 30), (None, "b c " * 20), (None, None),
    (6, "x y " * 13), (7, "w" * 50_000), (8, "p q r " * 3000), (9, "tail " + "m n\n" * 8 + " end"),
]


def test_periodic_runs_query(spark, documents, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90)))) for i in range(100, 190)]
    rows += [row for row in ODD if row[1] is None or len(row[1]) < 10_000]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(rows)
    expected = {}
    for row in rows:  # an id may have several texts
        expected.setdefault(row[0], []).append(plain_periodic([row])[row[0]])
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 190)) > 3
    assert Counter(got) == Counter((i, *v) for i, values in expected.items() for v in values)


def test_runs_keep_columns_and_odd_texts(spark, documents):
    docs = documents(ODD, ", runs string, _doc int", ("mine", 3))
    found = with_runs(docs).collect()
    assert len(found) == len(ODD)
    assert found[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "_doc", "runs", "collapsed"}
    by_text = {r.text: r for r in found}
    assert by_text["p q r " * 3000].collapsed == "p q r"
    assert by_text["a " * 30].runs == [(0, 30, 1)]
    assert by_text[None].collapsed == "" and by_text[None].runs == []
    assert by_text["w" * 50_000].collapsed == "w" * 50_000
    assert with_runs(docs.limit(0)).count() == 0


# ---- spelling ----


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_spelling(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if plain_near(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def variants(seed, n_stems=40):
    rng = random.Random(seed)
    letters = "aabécdeeo÷×ÿ"
    out = []
    for _ in range(n_stems):
        stem = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 11)))
        out += [stem] * rng.choice((2, 30, 250, 2500) if rng.random() < 0.5 else (2, 30))
        for _ in range(6):
            at, kind = rng.randrange(len(stem)), rng.randrange(3)
            word = stem[:at] + (rng.choice(letters) if kind else "") + stem[at + (kind != 1) :]
            out += [word] * rng.choice((1, 2, 3, 25, 260))
            at = rng.randrange(len(word) + 1)
            out += [word[:at] + rng.choice(letters) + word[at:]] * rng.choice((2, 3))
    return out


def test_neighbours_are_those_of_all_pairs(spark):
    words = Counter(variants(7, 25))
    words = {w: n for w, n in words.items() if w}
    words.update({"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaa": 500, "baaaaaaa": 3, "aaaaaab": 7})
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r.word: (r.n_near, r.near, r.near_n) for r in neighbour_summaries(frame).collect()}
    for w in words:
        near = [v for v in words if plain_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert found.get(w) == ((len(near), best, words[best]) if near else None), w


def test_spelling_query(spark, documents, tmp_path):
    rng = random.Random(11)
    words = variants(11) + ["Caféter", "CAFÉTER", "cafÉter"] * 3 + ["short"] * 50
    rng.shuffle(words)
    rows = [(i, "  1,".join(words[a : a + 100])) for i, a in enumerate(range(0, len(words), 100))]
    rows += [(None, "abcdefgh abcdefgh"), (None, "abcdefgh"), (-4, ""), (5, None), (6, "中文 7"), (7, "z" * 40_000), (8, "z" * 40_000)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = op12_permuterm_variants(spark, str(tmp_path))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    expected = plain_spelling(rows)
    assert len(got) == len(expected) and set(got) == expected
    assert any(w != root and form != root for w, form, root, *_ in got if form)


def test_spelling_of_nothing_and_odd_columns(spark, documents):
    docs = documents([(1, "wordword Wordword")], ", word string, n long, root int", ("mine", 4, 5))
    assert [tuple(r) for r in counted(occurrences(docs)).collect()] == [("wordword", 2)]
    assert spelling_groups(counted(occurrences(docs.limit(0)))).count() == 0


# ---- lines ----


def line_key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_lines(rows, min_documents=10, least_chars=1):
    keys = [[line_key(line) for line in (text or "").split("\n")] for _, text in rows]
    count = Counter(k for ks in keys for k in set(ks) if len(k) >= least_chars)
    out = []
    for (doc_id, text), ks in zip(rows, keys):
        lines = (text or "").split("\n")
        keep = [line for line, k in zip(lines, ks) if not (len(k) >= least_chars and count[k] >= min_documents)]
        out.append((doc_id, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def line_rows(seed):
    rng = random.Random(seed)
    shared = [f"Line {i} of all" for i in range(40)] + ["", "  ", "État", "état", "x", " X\t", "中"]
    rows = []
    for i in range(120):
        lines = [rng.choice(shared) if rng.random() < 0.3 else f"own {rng.randrange(500)}" for _ in range(rng.randrange(1, 12))]
        rows.append((i if i % 17 else None, "\n".join(lines) + rng.choice(("", "\n", "\r\n"))))
    rows += [(500, None), (501, ""), (502, "\n"), (503, "x"), (503, "x"), (None, "x"), (504, "own\n" * 9000), (505, "l" * 100_000)]
    return rows + [(600 + i, "equal text\nof many\n") for i in range(30)] + [(9, "twice\nthe same row")] * 12


def test_line_query(spark, documents, tmp_path):
    import duckdb

    rows = line_rows(1)
    docs = documents(rows)
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in op13_line_dedup(spark, str(tmp_path)).collect())
    assert got == Counter(plain_lines(rows))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(db.execute(ORACLE_SQL).fetchall()) == got


def test_line_parameters_columns_and_nothing(spark, documents):
    rows = line_rows(2)
    docs = documents(rows, ", kept string, portion int, row_key int, lines int, keep int, body int", ("mine", 1, 2, 3, 4, 5))
    found = without_common_lines(docs, 4, 3)
    assert found.columns == [*(c for c in docs.columns if c != "kept"), "n_lines", "n_dropped", "kept"]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in found.collect())
    assert got == Counter(plain_lines(rows, 4, 3))
    assert without_common_lines(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_keeps_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 1000, 20_000):
        keys = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
        assert sorted(PerfectHash.of(keys).slots(keys).tolist()) == list(range(len(keys)))
        counts = rng.integers(1, 70_000 if n > 63 else 200, len(keys))
        arrays = shard_arrays(keys, counts)
        assert (Shard(*arrays).counts(keys) == counts).all()
        if n >= 1000:  # about 4 bits of index, two bytes of fingerprint and a count a key
            assert len(arrays[1]) * 8 < 5 * n and len(arrays[2]) == 2 * len(keys)
    foreign = np.unique(rng.integers(1, 1 << 63, 200_000).astype(np.uint64))
    assert (Shard(*arrays).counts(np.setdiff1d(foreign, keys)) > 0).sum() < 20


def test_many_shards_and_groups_probe_alike(spark, documents, monkeypatch):
    from lotframe.llm import line_dedup

    rows = line_rows(3)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    monkeypatch.setattr(line_dedup, "PACKED", 2)
    docs = documents(rows).repartition(6)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in without_common_lines(docs).collect())
    assert got == Counter(plain_lines(rows))
    lines = hashed_lines(docs)
    index, bits = line_index(lines)
    assert bits >= 6 and index.count() > 40
    # A hash of a portion comes back once, however many of its documents hold it.
    back = defaultdict(list)
    for r in common_keys(lines, index, bits, 10).collect():
        back[r.portion] += np.frombuffer(r.hashes, np.uint64).tolist()
    assert back and all(len(keys) == len(set(keys)) for keys in back.values())
