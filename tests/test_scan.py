"""Files read in many blocks against sequential parsers."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from quern.sources import readers, scan


@pytest.fixture
def blocks(spark):
    """Blocks of so many bytes that nearly every record spans some."""
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}

    def of(size):
        keys["spark.sql.files.maxPartitionBytes"] = str(size)
        for k, v in keys.items():
            spark.conf.set(k, v)

    yield of
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def machine(line, sep, inside):
    """The states of a reader, one character after the other."""
    state = "quoted" if inside else "start"
    for c in line:
        if state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif state == "closing":
            state = "quoted" if c == '"' else "start" if c == sep else "plain"
        elif c == sep:
            state = "start"
        else:
            state = "quoted" if state == "start" and c == '"' else "plain"
    return state == "quoted"


@pytest.mark.parametrize("sep", [",", "\t", "|"])
def test_states_of_lines(spark, sep):
    rng = random.Random(sep)
    lines = ["".join(rng.choice('"""ab' + sep * 2 + " ") for _ in range(rng.randrange(14))) for _ in range(4000)] + ['"' * k for k in range(12)] + ["x" * 100_000 + '"' * 50_001, '"' * 100_001]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    for r in df.select("value", *(c.alias(f"t{k}") for k, c in enumerate(scan.quoted_after(F.col("value"), sep)))).collect():
        assert (r["t0"], r["t1"]) == (machine(r["value"], sep, False), machine(r["value"], sep, True)), r["value"][:60]


def field(rng):
    plain = "".join(rng.choice("abc é1 ") for _ in range(rng.randrange(8)))
    kind = rng.randrange(5)
    if kind == 0:  # quotes, line ends and separators in quotes
        inner = "".join(rng.choice(['""', "\n", ",", "x", "y z", "\n\n", '"",""']) for _ in range(rng.randrange(6)))
        return f'"{inner}"'
    return plain.strip() + ('" b' if kind == 1 and plain.strip() else "")  # a stray one


def table(seed, n=120):
    rng = random.Random(seed)
    lines = [f"{k}," + ",".join(field(rng) for _ in range(3)) for k in range(n)]
    return "id,a,b,c\n" + "\n".join(lines) + "\n"


@pytest.mark.parametrize(("seed", "size", "end"), [(1, 300, "\n"), (2, 170, "\r\n"), (4, 1 << 20, "\n")])
def test_csv_equals_a_sequential_parser(spark, blocks, tmp_path, seed, size, end):
    text = table(seed)
    (tmp_path / "t.csv").write_bytes(text.replace("\n", end).encode())
    want = list(csv.reader(io.StringIO(text, newline="")))[1:]
    blocks(size)
    df = readers.read(spark, str(tmp_path / "t.csv"), "csv")
    assert df.columns == ["id", "a", "b", "c"]
    got = {int(r["id"]): [r[c] or "" for c in "abc"] for r in df.collect()}
    assert len(got) == len(want)
    norm = lambda x: x.replace("\r\n", "\n").strip()  # noqa: E731  Spark trims nothing inside quotes; blanks around plain fields differ
    assert {k: [norm(str(x)) for x in v] for k, v in got.items()} == {int(w[0]): [norm(x) for x in w[1:]] for w in want}


def test_csv_of_several_files_and_an_open_quote(spark, blocks, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"x\ny"\nk,t\n2,"""q"" z"\n')
    (tmp_path / "b.csv").write_text('k,t\n3,5" pipe\n4,"two\n\nlines"\n5,"never closed\n6,b\n')
    blocks(16)
    got = {r["k"]: r["t"] for r in readers.read(spark, str(tmp_path), "csv").collect()}
    assert got == {"1": "x\ny", "k": "t", "2": '"q" z', "3": '5" pipe', "4": "two\n\nlines"}


def test_one_stray_quote_leaves_a_file_split(spark, blocks, tmp_path):
    (tmp_path / "s.csv").write_text("k,t\n" + "\n".join(f'{k},{"5 inch 3" + chr(34) if k == 7 else "plain"} text' for k in range(2000)) + "\n")
    blocks(2000)
    df = readers.read(spark, str(tmp_path / "s.csv"), "csv")
    assert df.count() == 2000 and df.rdd.getNumPartitions() > 10


def test_latin_csv_with_line_ends(spark, blocks, tmp_path):
    (tmp_path / "l.csv").write_bytes('k;t\n1;"é\nü"\n2;ñ\n'.replace(";", ",").encode("latin-1"))
    blocks(10)
    got = {r["k"]: r["t"] for r in readers.read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").collect()}
    assert got == {1: "é\nü", 2: "ñ"}


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 4:
        return rng.choice([None, True, 5, "a } b", "{[", "]}", 'q " \\ z', "é\n", "", "\\"])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {f"k{j}": value(rng, depth + 1) for j in range(rng.randrange(3))}


@pytest.mark.parametrize(("size", "indent"), [(500, None), (900, 2), (1 << 20, None)])
def test_json_array_in_blocks(spark, blocks, tmp_path, size, indent):
    rng = random.Random(size)
    rows = [{"id": k, "text": json.dumps(value(rng)), "inner": {"s": rng.choice(["}", "{", '"', "\\", "x"]), "l": [k, k + 1]}} for k in range(200)]
    (tmp_path / "a.json").write_text(" \n" + json.dumps(rows, indent=indent, ensure_ascii=rng.random() < 0.5) + "\n")
    blocks(size)
    df = readers.read(spark, str(tmp_path / "a.json"), "json")
    got = {r["id"]: (r["text"], r["inner"]["s"], r["inner"]["l"]) for r in df.collect()}
    assert got == {r["id"]: (r["text"], r["inner"]["s"], r["inner"]["l"]) for r in rows}
    if size < 1000:
        assert scan.pieces(spark, str(tmp_path / "a.json"), "}").rdd.getNumPartitions() > 20


def test_other_json_arrays(spark, tmp_path):
    for name, text, n in (("s", "[1, 2, 3]", None), ("m", '[{"a": 1}, 5]', None), ("e", "[]", None), ("b", '[{"a": 1}, {"a": ', None), ("o", '[{"a": 1},\n{"a": 2}]', 2)):
        (tmp_path / f"{name}.json").write_text(text)
        df = readers.read(spark, str(tmp_path / f"{name}.json"), "json")
        assert n is None or df.count() == n
