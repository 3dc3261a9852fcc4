"""Files whose cells hold line breaks, cut into splits anywhere, against a reader of the whole file."""

import csv
import io
import random

import pytest

from kinfold.sources import records, tables


def made(rng, rows):
    cells = ["a", "", "x y", "two\nlines", 'say ""hi""', "1,5", "\n", "tail\n\n", "é", "plain\nand, more", '""']
    lines = ["Description,Plant,Note"]
    for _ in range(rows):
        row = []
        for _ in range(rng.choice([3, 3, 3, 2])):
            cell = rng.choice(cells)
            row.append(f'"{cell}"' if rng.random() < 0.5 or set(cell) & set('\n,"') else cell)
        lines.append(",".join(row) or "x")
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


def by_whole_file(text):
    rows = list(csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline="")))[1:]
    return [tuple((c or None) for c in (*r, "", "", "")[:3]) for r in rows if any(c.strip() for c in r) or len(r) > 1]


def pieced(text, cuts, separator=","):
    """What the functions make of a text whose lines are dealt to splits at these lines."""
    lines = list(enumerate(text.split("\n")))
    bounds = [0, *cuts, len(lines)]
    splits = {a: lines[a:b] for a, b in zip(bounds, bounds[1:]) if a < b}
    seen = []
    for place, some in splits.items():
        split = records.Split()
        for row, line in some:
            split.add(row, line, separator)
        seen.append((place, split.ends, split.last))
    begin, out = records.states(seen), {}
    for place, some in splits.items():  # as if each were a task of its own
        joiner = records.Joiner(begin, separator)
        for row, _, _, value in [r for row, line in some for r in joiner.add(place, row, line)] + joiner.flush():
            out[row] = out[row] + "\n" + value if row in out else value
    return [out[row] for row in sorted(out)]


@pytest.mark.parametrize("seed", range(30))
def test_records_don_t_depend_on_the_cuts(seed):
    rng = random.Random(seed)
    text = made(rng, 12).replace("\r\n", "\n") + rng.choice(["", '\n5" pipe,"x"y, "z\nw"\n', '\n"never closed, a\nb'])
    whole = pieced(text, [])
    assert "\n".join(whole) == text
    for cut in range(1, text.count("\n") + 1):
        assert pieced(text, [cut]) == whole
    for _ in range(20):
        assert pieced(text, sorted(rng.sample(range(1, text.count("\n") + 1), min(5, text.count("\n"))))) == whole


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_file_cut_at_every_few_bytes(spark, tmp_path, seed):
    rng = random.Random(seed)
    text = made(rng, 25)
    (tmp_path / "a.csv").write_bytes(text.encode())
    want, before = by_whole_file(text), {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (7, 20, 33, 90, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = [tuple(r)[1:] for r in tables.read_table(spark, str(tmp_path / "a.csv"), tables.Layout(0, ",", "UTF-8", ("a", "b", "c"))).orderBy("_row").collect()]
            assert got == want, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_odd_quote_leaves_the_rest_as_it_is(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Description,Plant\npipe 5" long,U1\nnut,U2\n"bolt\nlong",U3\n')
    got = [tuple(r)[1:] for r in tables.read_table(spark, str(tmp_path / "b.csv")).orderBy("_row").collect()]
    assert got == [('pipe 5" long', "U1"), ("nut", "U2"), ("bolt\nlong", "U3")]
