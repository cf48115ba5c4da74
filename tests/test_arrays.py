"""Arrays in many ranges against the standard library's parser."""

import json
import random

import pytest
from tubeql.sources import arrays, submissions


def cuts(path, size):
    """All elements by ranges of a size, one after another, with the state that the summaries give."""
    length, odd, depth, out = path.stat().st_size, 0, 0, []
    for start in range(0, length, size):
        end = min(length, start + size)
        out += arrays.cut(str(path), start, end, bool(odd), depth)
        flips, outside, inside = arrays.summary(str(path), start, end)
        depth += inside if odd else outside
        odd ^= flips
    assert (odd, depth) == (0, 0)
    return [json.loads(t) for _, t in out]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    text = "".join(rng.choice('ab"\\[]{},: \né漢\U0001f600') for _ in range(rng.randrange(12)))
    if kind < 2:
        return text
    if kind < 4:
        return rng.choice([None, True, -1.5, 7, "\\" * rng.randrange(9)])
    if kind == 4:
        return {text + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_elements_at_any_border(tmp_path, monkeypatch, block):
    monkeypatch.setattr(arrays, "BLOCK", block)
    rng = random.Random(block)
    for k in range(25):
        data = [value(rng) for _ in range(rng.randrange(9))]
        file = tmp_path / f"{k}.json"
        file.write_text(json.dumps(data, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5), encoding="utf-8")
        for size in (1, 2, 5, 17, 1 << 20):
            assert cuts(file, size) == data


def test_many_files_and_errors(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for k in range(4):
        data = [value(rng) for _ in range(60)] + ["\\" * 9_001, "x" * 20_000]
        want += data
        (tmp_path / f"{k}.json").write_text(json.dumps(data))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "lines.json").write_text("[1]\n[]\n[2, 3]\n")
    rows = arrays.elements(spark, str(tmp_path / "*.json"), range_bytes=700)
    assert rows.rdd.getNumPartitions() > 20
    assert [json.loads(r.value) for r in sorted(rows.collect(), key=lambda r: (r.path, r.place))] == want + [1, 2, 3]
    for text, message in (('{"a": [1, 2]}', "something else"), ('[1, "]', "ends inside")):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(Exception, match=message):
            arrays.elements(spark, str(tmp_path / "bad"), range_bytes=4).collect()
    (tmp_path / "none.json").write_text("[ ]")
    assert arrays.elements(spark, str(tmp_path / "none.json")).count() == 0


def test_last_tubes_equal_tubes(spark, tmp_path):
    box = lambda f, x: {"frame": f, "x1": x, "y1": x, "x2": x + 2, "y2": x + 3}
    entries = [{"video_id": v, "annotations": [{"bboxes": [box(f, k + f) for f in range(k % 4)]}] * (k % 3)} for k, v in enumerate("abcabdaab")] + [{"video_id": None}, {"video_id": "z"}]
    (tmp_path / "a.json").write_text(json.dumps(entries[:5], indent=2))
    (tmp_path / "b.json").write_text(json.dumps(entries[5:]))
    texts = spark.read.text(str(tmp_path / "*.json"), wholetext=True).selectExpr("value", "_metadata.file_path AS path")
    want = sorted(map(tuple, submissions.tubes(submissions.parse(texts, order="path")).collect()))
    assert want
    for size in (64, 1 << 20):
        assert sorted(map(tuple, submissions.last_tubes(submissions.scan(spark, str(tmp_path / "*.json"), range_bytes=size)).collect())) == want
