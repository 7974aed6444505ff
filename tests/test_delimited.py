"""Delimited files against a plain reader of whole texts, however they are split."""

import random

import pytest

from fieldlink.operators import profile
from fieldlink.plans import mapping
from fieldlink.sources import delimited, files


def whole_text(text, sep):
    """Cells of all records of more than white space, character by character; None if a quote is broken."""
    rows, row, cell, i, n = [], [], "", 0, len(text)
    while i <= n:
        if i < n and text[i] == '"' and cell == "" and (i == 0 or text[i - 1] in sep + "\n"):
            i += 1
            while True:
                if i >= n:
                    return None
                if text[i] == '"' and text[i + 1 : i + 2] == '"':
                    cell, i = cell + '"', i + 2
                elif text[i] == '"':
                    i += 1
                    break
                else:
                    cell, i = cell + text[i], i + 1
            while text[i : i + 1] == " ":
                i += 1
            if i < n and text[i] not in sep + "\n":
                return None
        if i == n or text[i] == "\n":
            row.append(cell)
            if "".join(row).strip():
                rows.append(row)
            row, cell = [], ""
        elif text[i] == sep:
            row.append(cell)
            cell = ""
        else:
            cell += text[i]
        i += 1
    return rows


@pytest.fixture
def splits(spark):
    """Sets the bytes of a split."""

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def ordered(df, order="_at"):
    names = [c for c in df.columns if c != order]
    return names, [tuple(r[c] for c in names) for r in df.orderBy(order).collect()]


def test_ragged_rows_are_filled_and_cut(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2\n3,4,5,6\n")
    assert ordered(files.read_text_table(spark, f"file://{tmp_path}", order="_at")) == (["a", "b", "c"], [("1", "2", None), ("3", "4", "5")])


@pytest.mark.parametrize("text,fault", [('a,b\n1,"2\n3,4\n', "never closed"), ('a,b\n1,"2"x\n', "followed")])
def test_broken_quotes_fail(spark, tmp_path, text, fault):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(ValueError, match=fault):
        files.read_text_table(spark, f"file://{tmp_path}")


def test_quotes_over_many_blocks_read_as_one(spark, tmp_path, splits):
    made = random.Random(4)
    cell = lambda: made.choice(["x", "12", "", '"a,b"', '"two\nlines"', '"q""q"', '"\n\n,"', 'in"side', '"end" ', "é" * made.randint(1, 9)])
    text = "k,v,w\n" + "\n".join(",".join(cell() for _ in range(made.randint(1, 5))) for _ in range(200)) + "\n"
    (tmp_path / "a.csv").write_text(text)
    rows = whole_text(text, ",")
    want = [tuple((c or None) for c in (r + [""] * 3)[:3]) for r in rows[1:]]
    for n in (1 << 20, 700, 90):
        splits(n)
        df = files.read_text_table(spark, f"file://{tmp_path}", order="_at")
        assert ordered(df) == (["k", "v", "w"], want)
    assert delimited.Source(spark, f"file://{tmp_path}").n_blocks > 20


def test_each_file_has_its_delimiter_and_header(spark, tmp_path, splits):
    (tmp_path / "1.csv").write_text("\n\nid;amount;note\n1;2,5;a,b\n" + "2;3;c\n" * 40)
    (tmp_path / "2.csv").write_text("id,amount,note\n" + "".join(f'{i},7,"x\n{i}"\n' for i in range(60)))
    (tmp_path / "3.csv").write_text(" \n , \n")
    want = [("1", "2,5", "a,b")] + [("2", "3", "c")] * 40 + [(str(i), "7", f"x\n{i}") for i in range(60)]
    for n in (1 << 20, 64):
        splits(n)
        assert ordered(files.read_text_table(spark, f"file://{tmp_path}", order="_at")) == (["id", "amount", "note"], want)
    assert [r.sep for r in delimited.Source(spark, f"file://{tmp_path}").delimiters().orderBy("file").collect()] == [";", ",", ","]


def test_header_after_many_blank_lines_mark_and_crlf(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + b" , \r\n" * 100 + b'N,"V ""1"""\r\n1,2\r\n')
    assert ordered(files.read_text_table(spark, f"file://{tmp_path}", order="_at")) == (["N", 'V "1"'], [("1", "2")])


def test_a_folder_of_files_maps_alike_however_it_is_split(spark, tmp_path, splits):
    """Two folders of several files, with places of rows: ties of top values go to the first row of the first file."""
    for name, sep, shift in (("a", ";", 0), ("b", "|", 1)):
        (tmp_path / name).mkdir()
        for k in range(3):
            lines = [f"REF{k}{i:07d}{sep}{i * 3 + k}.50{sep}kind{(i + shift) % 4}" for i in range(30)]
            (tmp_path / name / f"{k}.csv").write_text(sep.join(["Txn Ref", "Amount", "Kind"]) + "\n" + "\n".join(lines) + "\n")
    seen = []
    for n in (1 << 20, 150):
        splits(n)
        a, b = (files.read_text_table(spark, f"file://{tmp_path}/{x}", order="_at") for x in "ab")
        m = mapping.map_columns(a, b, order="_at")
        top = profile.top_values(m.dictionary).where("side = 'A' and col_idx = 2").orderBy("rank").collect()
        seen.append((sorted((r.source_id, r.target_id, r.category) for r in m.results.collect()), [r.value for r in top]))
    assert seen[0] == seen[1] and seen[0][0][:2] == [("A_1", "B_1", "exact"), ("A_2", "B_2", "exact")] and seen[0][1] == ["kind0", "kind1", "kind2", "kind3"]


def test_no_row_at_all(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n , \n")
    df = files.read_text_table(spark, f"file://{tmp_path}")
    assert df.columns == [] and df.count() == 0


def test_many_blocks_are_dealt_out_where_the_plan_is_not_broadcast(spark, tmp_path, splits, monkeypatch):
    text = "a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(50))
    (tmp_path / "a.csv").write_text(text)
    splits(80)
    monkeypatch.setattr(delimited, "PLANNED", 3)
    assert ordered(files.read_text_table(spark, f"file://{tmp_path}", order="_at"))[1] == [(str(i), f"x\n{i}") for i in range(50)]
