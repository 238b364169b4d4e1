"""A1: JSON arrays by byte ranges against json.loads."""

import json
import random

import pytest

from qcorpus.sources import json_array as J

SCHEMA = "a string, b array<string>, c struct<d: string, e: array<bigint>>"


def record(rng):
    text = lambda: "".join(rng.choice(['"', "\\", "\\\\", ",", "[", "]", "{", "}", "\n", "é", "🐋", "x", " ", '\\"']) for _ in range(rng.randint(0, 12)))
    out = {"a": text(), "b": [text() for _ in range(rng.randint(0, 3))], "c": {"d": text(), "e": [rng.randint(0, 9)]}}
    return {k: v for k, v in out.items() if rng.random() < 0.8}


def key(r):
    return json.dumps(r, sort_keys=True)


def rows_of(df):
    out = []
    for r in df.collect():
        d = r.asDict(recursive=True)
        out.append(key({k: v for k, v in d.items() if v is not None}))
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 20, 211, 17])
def test_any_range_gives_the_same_rows(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(J, "BUFFER_BYTES", 64)
    rng = random.Random(size)
    files = [[record(rng) for _ in range(n)] for n in (0, 1, 25)]
    for k, rs in enumerate(files):
        (tmp_path / f"{k}.json").write_text(json.dumps(rs, indent=rng.choice([None, 2]), ensure_ascii=bool(k % 2)))
    (tmp_path / "two.json").write_text(json.dumps(files[1]) + "\n" + json.dumps(files[2]) + "\n[ ]")
    (tmp_path / "empty.json").write_text("")
    got = rows_of(J.read_json_array(spark, str(tmp_path), SCHEMA, range_bytes=size))
    assert got == sorted(key(r) for rs in [*files, files[1], files[2]] for r in rs)


def test_every_start_state_is_found():
    """scan() of halves equals scan() of the whole, at every place."""
    rng = random.Random(3)
    for _ in range(40):
        data = json.dumps([record(rng) for _ in range(2)], ensure_ascii=False).encode()
        at, change, end = J.scan(data, J.OUTSIDE)
        assert end == J.OUTSIDE and change.sum() == 0
        for cut in range(len(data) + 1):
            a1, c1, state = J.scan(data[:cut], J.OUTSIDE)
            a2, c2, _ = J.scan(data[cut:], state)
            assert a1.tolist() + (a2 + cut).tolist() == at.tolist() and c1.tolist() + c2.tolist() == change.tolist()


def test_long_element_and_cut_file(spark, tmp_path):
    rows = [{"a": "x" * 3_000_000}, {"a": "y"}]
    (tmp_path / "long.json").write_text(json.dumps(rows))
    got = J.read_json_array(spark, str(tmp_path), "a string", range_bytes=100_000)
    assert sorted(len(r["a"]) for r in got.collect()) == [1, 3_000_000]
    (tmp_path / "long.json").write_text(json.dumps(rows)[:-5])
    with pytest.raises(Exception, match="cut off"):
        J.read_json_array(spark, str(tmp_path), "a string", range_bytes=100_000).collect()


def test_round_trip_through_the_writer(spark, tmp_path):
    rows = [(k, k // 4, f'te"xt\\ {k},\n', None if k % 3 else "n") for k in range(20)]
    df = spark.createDataFrame(rows, "id long, part long, text string, other string")
    J.write_json_array(df, str(tmp_path / "w"), "part", "id")
    got = J.read_json_array(spark, str(tmp_path / "w"), "id long, part long, text string, other string", range_bytes=50)
    assert sorted(map(tuple, got.collect())) == rows
