"""CSV files read in many blocks against Python's reader of the whole file."""

import csv
import io
import random

import pytest

from maskwerk.sources import csv_splits as C
from maskwerk.sources import files


def plain(text, sep=","):
    """Records as Python's reader has them."""
    return [r or [""] for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=sep)]


def made(seed, rows, sep=","):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "a", "b c", "line\nfeed", "two\n\nfeeds", 'a "quoted" word', '"', '""', f"x{sep}y", "ü梦", "carriage\r\nreturn", "long " * 30, '\n"\n'])
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerows([cell() for _ in range(rng.randrange(1, 6))] for _ in range(rows))
    return out.getvalue()


@pytest.fixture
def small_blocks(spark):
    """Blocks of 400 bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "400")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, path, sep=",", **options):
    rows = C.records(spark, str(path), sep, **options).orderBy("path", "row").collect()
    assert [r["row"] for r in rows] == [*range(len(rows))]
    return [C.fields(r["text"], sep) for r in rows]


@pytest.mark.parametrize("seed", range(4))
def test_blocks(spark, tmp_path, small_blocks, seed):
    text = "﻿" * (seed % 2) + made(seed, 150, ",;"[seed % 2])
    (tmp_path / "a.csv").write_bytes(text.encode())
    assert C._lines(spark, str(tmp_path / "a.csv")).select("block").distinct().count() > 10
    options = {"most_blocks": 0} if seed > 1 else {}
    assert read(spark, tmp_path / "a.csv", ",;"[seed % 2], **options) == plain(text, ",;"[seed % 2])


def test_odd_files(spark, tmp_path, small_blocks):
    long = '"' + "many\nlines\n" * 200 + '",end\n'
    for n, text in enumerate(["", "\n", "\n\n", "a", "a,b", 'a,"b', 'a,"b\nc', 'a"b,c"d\n5" pipe,"x"y"z\n', '"a"b,"c""d"\n', long + "x,y\n", "a,b\n" + long + long, 'x,"' + "\n" * 900 + "z", ",,\n,\n"]):
        (tmp_path / f"{n}.csv").write_bytes(text.encode())
        assert read(spark, tmp_path / f"{n}.csv") == plain(text), text[:40]


def test_folders(spark, tmp_path, small_blocks):
    texts = {n: made(n, 30) for n in range(4)}
    for n, text in texts.items():
        (tmp_path / f"{n}.csv").write_bytes(text.encode())
    got = C.cells(C.records(spark, str(tmp_path), ","), ",").collect()
    want = {(n, r, c, x) for n, text in texts.items() for r, row in enumerate(plain(text)) for c, x in enumerate(row) if x}
    assert {(int(r["path"][-5]), r["row"], r["col"], r["text"]) for r in got} == want and len(got) == len(want)


def test_an_open_mark_is_an_error(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('a\n"' + "b\n" * 500)
    with pytest.raises(Exception, match="open"):
        read(spark, tmp_path / "a.csv", most=150)
    with pytest.raises(Exception, match="open"):
        read(spark, tmp_path / "a.csv", most=400)


def test_states_of_lines():
    """A line's end state, from either state, is what joining it to what was before gives."""
    rng = random.Random(2)
    for _ in range(4000):
        line = "".join(rng.choice('",;a ') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line + "\n"
            probe = [*csv.reader(io.StringIO(text + "q", newline=""))]
            assert C.inside_at_end(line, inside, ",") == (len(probe) == 1), (line, inside)


def test_reader_gives_rows_of_the_file(spark, tmp_path, small_blocks):
    text = "".join(f'{i};"x ""{i}"", y{chr(10) * (i % 3 == 2)}";{"ü" * (i % 4)}\r\n' for i in range(200))
    text = text.replace("\n\";", "\nnext;line;\";")
    (tmp_path / "b.csv").write_bytes(text.encode())
    got = files.read_csv(spark, str(tmp_path / "b.csv")).orderBy("seg_no").collect()
    assert [(r["row"], r["col"], r["text"]) for r in got] == [(r, c, x) for r, row in enumerate(plain(text, ";")) for c, x in enumerate(row) if x]
