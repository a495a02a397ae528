"""Artifacts read in ranges: any cut gives what the whole text gives."""

import random

import pytest

from crawlscope.operators import ranges as RG


def csv_text(rng):
    cells = ["a", "", '"x,""y"""', '"two\nlines"', '"``` \n"', "é😀", '"\n\n"']
    return "".join(",".join(rng.choice(cells) for _ in range(6)) + "\n" for _ in range(40)) + rng.choice(["", "last", '"open\n1\n'])


def markdown_text(rng):
    lines = ["## page", "text", "", "```json", "```", "````", "`````json", "`````", "### block", "``` ", "``x", "# é😀"]
    return "\n".join(rng.choice(lines) for _ in range(150)) + rng.choice(["", "\n"])


def json_text(rng):
    pages = ["    {\n      \"page\": {\n        \"x\": \"" + "é" * rng.randrange(30) + "\"\n      }\n    }" for _ in range(rng.randrange(1, 20))]
    return '{\n  "scan": {\n    "settings": {\n      "a": 1\n    }\n  },\n  "pages": [\n' + ",\n".join(pages) + "\n  ]\n}"


def whole(fmt, text):
    """Records of the whole text in one go."""
    out, held, state, record = [], [], 0, 0
    lines = text.encode().split(b"\n")
    for k, raw in enumerate(lines):
        if k == len(lines) - 1 and not raw:
            break
        starts, state = RG.step(fmt, state, RG.Line(raw, raw.count(b'"'), len(raw), True))
        if starts:
            if held:
                out.append((record, "\n".join(held)))
            record, held = record + 1, []
        held.append(raw.decode())
    return out + [(record, "\n".join(held))], state


@pytest.mark.parametrize("fmt,make", [("csv", csv_text), ("markdown", markdown_text), ("json", json_text)])
def test_random_cuts(spark, tmp_path, fmt, make):
    rng = random.Random(fmt)
    ext = "md" if fmt == "markdown" else fmt
    texts = {f"t{k}.{ext}": make(rng) for k in range(6)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for size in (1, 7, 64, rng.randrange(100, 400), 1 << 20):
        starts = RG.true_starts(RG.file_ranges(spark, str(tmp_path), size)).cache()
        got = {}
        for r in RG.records(starts).collect():
            got.setdefault(r.name, []).append((r.record, r.text))
        ends = {r.name: r for r in RG.artifacts(starts).collect()}
        for name, text in texts.items():
            want, state = whole(fmt, text)
            assert sorted(got[name]) == want
            assert ends[name].state == state and ends[name].bytes == len(text.encode()) and ends[name].ended == text.endswith("\n")
        starts.unpersist()


def test_no_task_reads_a_whole_artifact(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a,b,c,d,e,f\n" * 5000)
    ranges = RG.file_ranges(spark, str(tmp_path), 4096)
    assert ranges.count() == 15
    plan = RG.records(RG.true_starts(ranges))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan or "content" not in plan
