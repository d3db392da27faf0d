"""The binary format of word vectors: ranges give the rows that one pass gives."""

import numpy as np
import pytest

from visitloom.sources import readers, wordvectors


def write(path, rows, size, feed=b"", junk=b""):
    with open(path, "wb") as f:
        f.write(f"{len(rows)} {size}\n".encode())
        for w, v in rows:
            f.write(w.encode() + b" " + np.asarray(v, "<f4").tobytes() + feed)
        f.write(junk)


def some(n, size, seed=0):
    rng = np.random.default_rng(seed)
    # components whose bytes look like blanks and letters, where a start could be taken by mistake
    odd = np.frombuffer(b"   >a b=x y\xbdq  >", "<f4")
    rows = []
    for i in range(n):
        v = rng.normal(size=size).astype("f4")
        v[rng.integers(0, size, 3)] = rng.choice(odd, 3)
        rows.append((f"wörd{i}" * int(rng.integers(1, 4)), v))
    return rows


@pytest.mark.parametrize("feed", [b"", b"\n"])
@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_ranges_give_the_same_rows(spark, tmp_path, monkeypatch, feed, ranges):
    monkeypatch.setattr(wordvectors, "ROWS", 50)
    path, rows = str(tmp_path / "v.bin"), some(1500, 25)
    write(path, rows, 25, feed)
    df = readers.word_vectors_binary(spark, path, ranges)
    got = {r["word"] + str(r["vec"][0]): r["vec"] for r in df.collect()}
    assert df.count() == 1500 and len(got) == len({w + str(float(v[0])) for w, v in rows})
    assert all(got[w + str(float(v[0]))] == [float(x) for x in v] for w, v in rows)
    size, cuts = wordvectors.starts(path, ranges)
    assert size == 25 and len(cuts) == ranges + 1 and df.rdd.getNumPartitions() == ranges


def test_a_range_holds_one_block(tmp_path, monkeypatch):
    monkeypatch.setattr(wordvectors, "BLOCK", 4096)
    path, rows = str(tmp_path / "v.bin"), some(600, 30, 1)
    write(path, rows, 30)
    reader = wordvectors.Reader(path, 3)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 600


def test_small_empty_and_broken_files(spark, tmp_path):
    path = str(tmp_path / "v.bin")
    write(path, [], 3)
    assert readers.word_vectors_binary(spark, path, 5).count() == 0
    write(path, [("one", [1, 2, 3])], 3, b"\n")
    assert [tuple(r) for r in readers.word_vectors_binary(spark, "file://" + path, 5).collect()] == [("one", [1.0, 2.0, 3.0])]
    write(path, some(50, 8), 8, junk=b"cut \x00\x00")
    with pytest.raises(Exception, match="read it with ranges=1"):
        readers.word_vectors_binary(spark, path, 1).collect()


def test_a_start_that_is_none_is_an_error(tmp_path):
    path, rows = str(tmp_path / "v.bin"), some(100, 8)
    write(path, rows, 8)
    size, (first, total) = wordvectors.starts(path, 1)
    reader = wordvectors.Reader(path, 1)
    with pytest.raises(ValueError, match="read it with ranges=1"):
        list(reader.read(wordvectors.Range(path, size, first, first + 101)))
