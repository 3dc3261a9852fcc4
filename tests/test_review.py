"""Codes, seams and file sources on small cases."""

from kinfold.operators import codes
from kinfold.plans import review
from kinfold.sources import files


def test_proposed_codes(spark):
    rows = [(1, "SS BEARING BALL 6204"), (2, "BEARING ROLLER"), (3, "GASKET SPIRAL"), (4, "STEEL M12"), (5, None)]
    got = codes.propose(spark.createDataFrame(rows, "family_no long, golden string")).collect()
    assert {r["family_no"]: r["proposed_code"] for r in got} == {
        1: "MTL-BRNG-0002", 2: "MTL-BRNG-0001", 3: "MTL-GSKT-0001", 4: "MTL-GEN-0002", 5: "MTL-GEN-0001",
    }


def test_seams(spark):
    scores = [(1, 1.0), (1, 0.9), (1, 0.8), (1, 0.8), (2, 1.0), (2, 1.0), (3, 0.7)]
    got = review.seams(spark.createDataFrame(scores, "family_no long, score double")).collect()
    assert [tuple(r) for r in got] == [(1, 8000, 9000, 2, 4)]


def test_files(spark, tmp_path):
    for name, raw in {"a.csv": b"\xef\xbb\xbfx,y", "b.csv": "é€".encode("cp1252"), "g.csv": b"\xe9\x81", "h.csv": b"a" * 9000 + b"\0", "c.png": b"\x89PNG1", "d.txt": b"ab\x00", "e.txt": b"", "f.txt": b"P\x00"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["file"]: (r["refused"], r["text"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    binary = ("a binary file", None)
    assert got == {"a.csv": (None, "x,y"), "b.csv": (None, "é€"), "g.csv": (None, "é\x81"), "h.csv": (None, "a" * 9000 + "\0"), "c.png": ("a PNG image", None), "d.txt": binary, "f.txt": binary}
