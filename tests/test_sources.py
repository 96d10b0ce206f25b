"""Delimited files with all their quirks, typed tables, audits, and stored intermediates."""

import datetime
import random
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pytest

from counterfoil import SourceError, as_string_table, damaged_cells, decode_audit, profile, read_delimited, reconcile
from counterfoil.plans import storage
from counterfoil.sources.delimited import header_names
from counterfoil.sources.records import states
from counterfoil.spec import ReconSpec


@pytest.fixture
def file(tmp_path):
    def write(text, encoding="utf-8", name="f.csv"):
        (tmp_path / name).write_bytes(text.encode(encoding))
        return str(tmp_path / name)

    return write


def rows(source):
    return sorted((tuple(r) for r in source.table.collect()), key=repr)


def test_quirks(spark, file):
    path = file('﻿id,a,b\n1,x,"p ""q"" r"\n\n2,"",NA\n3,only\n4,a,b,c\n5,a,b,\n6,a,b,,x\n7,"a,b",c\n8," s ","u,v","w",z\n')
    source = read_delimited(spark, path)
    assert source.table.columns == ["id", "a", "b"]
    assert rows(source) == [("1", "x", 'p "q" r'), ("2", None, "NA"), ("3", "only", None), ("7", "a,b", "c")]
    assert sorted(r.record[0] for r in source.rejects.collect()) == ["4", "5", "6", "8"]
    with pytest.raises(Exception, match="more fields"):
        read_delimited(spark, path, strict=True).table.count()


def test_files_of_a_folder_must_share_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid,name\n1,x\n")
    (tmp_path / "b.csv").write_text("id,name\r\n2,y\r\n")
    assert read_delimited(spark, str(tmp_path)).table.count() == 2
    (tmp_path / "c.csv").write_text("name,id\nz,3\n")
    for multi_line in (None, True, False):
        with pytest.raises(SourceError, match="headers"):
            read_delimited(spark, str(tmp_path), multi_line=multi_line)


@pytest.mark.parametrize("encoding", ["utf-16", "utf-32"])
def test_files_of_wide_characters_must_share_their_header(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes("id,name\n1,x\n".encode(encoding))
    (tmp_path / "b.csv").write_bytes("id,name\n2,y\n3,z\n".encode(encoding))
    assert read_delimited(spark, str(tmp_path), encoding=encoding).table.count() == 3
    (tmp_path / "c.csv").write_bytes("name,id\nz,3\n".encode(encoding))
    with pytest.raises(SourceError, match="headers"):
        read_delimited(spark, str(tmp_path), encoding=encoding)


def test_windows_characters(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("näme;x\n€ “q”;\x9d\n".encode("cp1252", errors="ignore") + b"\x9d;1\n")
    table = read_delimited(spark, str(path), delimiter=";", encoding="Windows-1252").table
    assert table.columns == ["näme", "x"]
    assert sorted(tuple(r) for r in table.collect()) == [("€ “q”", None), ("\ufffd", "1")]
    with pytest.raises(SourceError, match="encoding"):
        read_delimited(spark, str(path), encoding="auto")


@pytest.mark.parametrize("multi_line", [None, True])
def test_fields_over_several_lines(spark, file, multi_line):
    path = file('id,a\n1,"x\ny"\n2,z\n')
    assert rows(read_delimited(spark, path, multi_line=multi_line)) == [("1", "x\ny"), ("2", "z")]


def test_plain_files_are_read_by_lines(spark, file):
    plan = read_delimited(spark, file("id,a\n1,x\n")).table._jdf.queryExecution().toString()
    assert "csv" in plan
    assert rows(read_delimited(spark, file("id,a\n1,x\n"), multi_line=False)) == [("1", "x")]


def test_options_and_pruning(spark, file):
    path = file("a;a;b.c;\n1;'2;2';3;4\n")
    source = read_delimited(spark, path, delimiter=";", quotechar="'")
    assert source.table.columns == ["a", "a.1", "b.c", "Unnamed: 3"]
    assert rows(source) == [("1", "2;2", "3", "4")]
    assert rows(read_delimited(spark, path, delimiter=";", quotechar="'", use_columns=["b.c", "a.1"])) == [
        ("3", "2;2")]
    with pytest.raises(SourceError):
        read_delimited(spark, path, delimiter=";", use_columns=["zz"])
    with pytest.raises(SourceError):
        read_delimited(spark, file("", name="empty.csv"))


def test_header_names():
    assert header_names(["a", "a", "a.1", None, "a"]) == ["a", "a.1", "a.1.1", "Unnamed: 3", "a.2"]


def test_encodings_and_decode_audit(spark, file):
    path = file("a,b\né,1\n", "latin-1")
    assert rows(read_delimited(spark, path, encoding="latin1")) == [("é", "1")]
    damaged = {r.column: r.damaged_cells for r in decode_audit(read_delimited(spark, path).table).collect()}
    assert damaged == {"a": 1, "b": 0}
    wide = file("a,b\né,1\n", "utf-16", "wide.csv")
    assert rows(read_delimited(spark, wide, encoding="utf-16")) == [("é", "1")]


def test_damage_is_seen_in_the_bytes(spark, tmp_path):
    path = str(tmp_path / "f.csv")
    body = 'a,b\n\ufffd,é\n"x\n\ufffdy",@\n@,@\n,z\n1,2,@\n'.encode().replace(b"@", b"\xe9")
    (tmp_path / "f.csv").write_bytes(body)

    def found(encoding):
        return {r.column: r.damaged_cells for r in damaged_cells(spark, path, encoding=encoding).collect()}

    assert found("utf-8") == {"a": 1, "b": 2}
    assert {r.column: r.damaged_cells for r in decode_audit(read_delimited(spark, path).table).collect()} == {"a": 3, "b": 2}
    assert found("latin-1") == {"a": 0, "b": 0}
    (tmp_path / "f.csv").write_bytes(b"a,b\n\x81,\xe9\n")
    assert found("cp1252") == {"a": 1, "b": 0}
    assert found("ascii") == {"a": 1, "b": 1}


def test_source_options_override_shared_ones():
    spec = ReconSpec.from_dict({
        "schema_version": "1.0",
        "import": {"delimiter": ";", "encoding": "latin-1"},
        "sources": {"source_a": {"file": "x", "delimiter": "|", "use_columns": ["k"]}, "source_b": {"file": "y"}},
        "compare": {"key_columns": ["k"], "column_mappings": [{"source_a": "v", "source_b": "v"}]},
    })
    a, b = spec.sources["source_a"], spec.sources["source_b"]
    assert (a.delimiter, a.encoding, a.use_columns) == ("|", "latin-1", ("k",))
    assert (b.delimiter, b.encoding, b.use_columns, b.quotechar) == (";", "latin-1", None, '"')


def test_typed_tables_as_text(spark):
    df = spark.createDataFrame(
        [(1, 12345678.5, 0.005, Decimal("1.50"), datetime.date(2024, 2, 3), True, ["a", None], None)],
        "i int, d double, e double, c decimal(9,2), t date, b boolean, l array<string>, n string",
    )
    assert as_string_table(df, {"e": 2}).first() == (
        "1", "12345678.5", "0.01", "1.50", "2024-02-03", "true", '["a",null]', None)


def test_profile(table):
    a, b = table("k v", [("1", "2")] * 3), table("k", [])
    assert sorted(tuple(r) for r in profile(a, b).collect()) == [("source_a", 3, 2), ("source_b", 0, 1)]


def test_intermediates_go_to_the_shared_folder_and_are_removed(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"], "column_mappings": [{"source_a": "v", "source_b": "v"}]}}
    with reconcile(table("k v", [("1", "2")]), table("k v", [("1", "2")]), job) as recon:
        assert recon.per_column().first().matched == 1
        assert len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir())


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://host:7077")
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(SourceError, match="checkpoint"):
        storage.shared_folder(cluster)
    context.master = "local[2]"
    assert storage.shared_folder(cluster)


# -- quoted line ends: the same rows from many blocks as from one task ---------------


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def both_ways(spark, path, trim="", **options):
    """The source read by blocks, equal to the one read by one task but for characters at the ends of cells."""
    split, whole = (read_delimited(spark, path, multi_line=m, **options) for m in (None, True))
    assert "from_csv" in split.table._jdf.queryExecution().toString()
    cut = lambda found: sorted(([c and c.rstrip(trim or "\0") for c in r] for r in found), key=repr)
    assert cut(split.table.collect()) == cut(whole.table.collect())
    assert sorted(r[0] for r in split.rejects.collect()) == sorted(r[0] for r in whole.rejects.collect())
    return split


def test_records_over_block_borders(spark, tmp_path, small_blocks):
    cells = ["plain", 'say ""this""', "two\nlines", "", "\n\n\n", 'end ""\n"" of', "comma, here", "long " * 60 + "\n" + "x" * 200]
    for f in range(3):
        lines = [f'{f}{i},"{cells[i % len(cells)]}",{"z" * (i % 5)}' for i in range(60)]
        (tmp_path / f"{f}.csv").write_text("id,text,end\n" + "\n".join(lines) + "\n" * f)
    split = both_ways(spark, str(tmp_path))
    assert split.table.count() == 180
    assert split.table.rdd.getNumPartitions() > 3


@pytest.mark.parametrize("seed", range(6))
def test_records_with_random_quotes(spark, tmp_path, small_blocks, seed):
    draw = random.Random(seed)
    text = "".join(draw.choice(['"', '"', ",", "\n", "a", "bc", '""', '",', ',"', " "]) for _ in range(900))
    (tmp_path / "a.csv").write_text('id,"te\nxt",end\n1,"x\ny",2\n' + text + '\n"')
    both_ways(spark, str(tmp_path), trim='"')


def test_records_in_other_character_sets(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes('\n\nid;näme\n1;\'é\nü\'\n2;"\n'.encode("latin-1") * 1 + b"3;\xe9" * 40 + b"\n")
    both_ways(spark, str(tmp_path), delimiter=";", quotechar="'", encoding="latin-1")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.csv").write_bytes(b'\xef\xbb\xbf"id","n"\r\n1,"x\r\ny"\r\n\r\n2,\xff\r\n')
    assert rows(both_ways(spark, str(tmp_path / "b"))) == [("1", "x\ny"), ("2", "\ufffd")]


def test_lone_carriage_returns_are_left_to_the_parser(spark, file):
    path = file('id,a\r1,"x\ry"\r2,"z\nw"\r')
    plan = read_delimited(spark, path).table._jdf.queryExecution().toString()
    assert "from_csv" not in plan and read_delimited(spark, path).table.count() == 2


def test_states_of_lines_follow_from_their_functions():
    draw = random.Random(2)
    for _ in range(200):
        n = draw.randint(0, 12)
        out, inn = (np.array([draw.random() < 0.5 for _ in range(n)], bool) for _ in range(2))
        for start in (False, True):
            want, s = [], start
            for k in range(n):
                s = bool(inn[k] if s else out[k])
                want.append(s)
            assert states(out, inn, start).tolist() == want
