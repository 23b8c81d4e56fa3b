"""Landed files as streams: any layout, any block size, damage, and memory that does not follow the size of a file."""

import gzip
import io
import json
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equiscan.sources import readers, streams

VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-9, 99), st.text(st.sampled_from('ab{}[]":,\\ \n漢'), max_size=8)),
    lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(st.text(st.sampled_from('ab{}"\\'), max_size=4), inner, max_size=3)),
    max_leaves=8,
)
RECORDS = st.lists(st.dictionaries(st.sampled_from(["Code", "C", "data", 'q"{', "n"]), VALUES, max_size=4), max_size=6)
PAGES = st.lists(st.tuples(RECORDS, st.booleans(), st.sampled_from([None, 1])), max_size=3)


def written(pages) -> str:
    texts = []
    for records, before, indent in pages:
        page = {"data": records}
        extra = {"pagination_key": 'da{ta": [{', "other": [{"data": [{"x": 1}]}], "n": {"data": [{"y": 2}]}}
        texts.append(json.dumps({**extra, **page} if before else {**page, **extra}, indent=indent, ensure_ascii=False))
    return "\n".join(texts)


@settings(max_examples=200, deadline=None)
@given(PAGES, st.sampled_from([1, 2, 3, 7, 64, 100_000]))
def test_records_are_those_of_the_documents_at_any_block_size(pages, block):
    got = [(d, p, json.loads(text)) for d, p, text in streams.records_of(io.StringIO(written(pages)), block)]
    assert got == [(d, p, record) for d, (records, *_) in enumerate(pages) for p, record in enumerate(records)]


@pytest.mark.parametrize("text", ['{"data": [{"a": 1}', '{"data": [{"a": 1}], "k": "x', '{"data": [{"a": 1}]]', '{"data": [{"a": "'])
def test_a_broken_document_is_an_error(text):
    with pytest.raises(ValueError):
        list(streams.records_of(io.StringIO(text)))


class Endless(io.TextIOBase):
    """A page of ``n`` records that is made while it is read."""

    def __init__(self, n: int, record: str) -> None:
        self.left, self.record, self.held = n, record, '{"data": ['

    def read(self, size=-1):
        while len(self.held) < size and self.left:
            take = min(self.left, 4_096)
            self.left -= take
            self.held += ",\n".join([self.record] * take) + (",\n" if self.left else "]}")
        out, self.held = self.held[:size], self.held[size:]
        return out


def test_memory_does_not_follow_the_size_of_a_page_file():
    record = json.dumps({"Code": "13010", "Nested": {"a": "}"}, "Text": "x" * 200})
    n = 200_000  # some 50 MB
    tracemalloc.start()
    found = sum(1 for _ in streams.records_of(Endless(n, record)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n and peak < 20e6


def test_one_long_value_is_read_in_proportion_to_its_length():
    text = json.dumps({"data": [{"Code": "1", "Text": "y" * 30_000_000}, {"Code": "2"}]})
    got = [json.loads(t)["Code"] for *_, t in streams.records_of(io.StringIO(text))]
    assert got == ["1", "2"]


def test_pages_without_a_schema_and_nested_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"Code": "1", "Reason": {"x": "1", "y": null}, "n": 5}], "pagination_key": "k"}\n{"data": []}\n{"data": [{"Code": "2", "B": true}]}')
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('{"data": [\n{"Code": "3", "n": "x", "L": [1, 2]}\n]}')
    read = readers.read_pages(spark, f"{tmp_path}/*")
    assert read.columns == ["B", "Code", "L", "Reason", "n", "_seq"]
    rows = {r.Code: r for r in read.collect()}
    assert (rows["1"].Reason.x, rows["1"].Reason.y, rows["1"].n) == ("1", None, "5")
    assert (rows["2"].B, rows["2"].Reason, rows["3"].n, rows["3"].L) == ("true", None, "x", ["1", "2"])
    assert [r.Code for r in sorted(rows.values(), key=lambda r: r._seq)] == ["1", "2", "3"]
    assert (rows["2"]._seq.block, rows["2"]._seq.place) == (2, 0)


def test_fields_are_collected_without_staging_the_records(spark, tmp_path):
    records = ['{"a":"1","b":"2"}', '{"a":"\\n","c":"}"}', '{"a":1}', '{"b":"1","a":"2","d":{"e":"{"}}', '{"a":"1","b":null}', '{"f":"x" ,"a":"]"}', '{"a":"漢","b":"\\""}']
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"data":[' + ",".join(records * 3) + "]}")
    read = readers.read_pages(spark, f"{tmp_path}/*")
    assert read.columns == ["a", "b", "c", "d", "f", "_seq"]
    assert [r._seq.place for r in sorted(read.collect(), key=lambda r: r._seq)] == list(range(21))
    assert "binaryFile" in read._jdf.queryExecution().toString()  # pages are read again, no copy of their texts is kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text(st.sampled_from('ab"\\{'), max_size=2), st.one_of(st.text(st.sampled_from('x"{}[],:\\\n漢'), max_size=4), VALUES), max_size=3), max_size=6))
def test_a_record_that_is_left_out_has_the_fields_of_one_that_is_kept(records):
    texts = [json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in records]
    for text, record in zip(texts, records, strict=True):
        names = streams._text_fields(text)
        assert names is None or names == tuple(record) and all(isinstance(v, str) for v in record.values())
    assert streams._text_fields('{"a":"1","b":"}"}') == ("a", "b")
    assert [streams._text_fields(t) for t in ('{"a":"1",}', '{"a":1}', "{}", '{"a":"\n"}', '{"a":"1""b":"2"}')] == [None] * 5


def test_a_page_file_that_breaks_off_stops_the_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"Code": "1"}, {"Code": ')
    with pytest.raises(Exception, match="a.json: the file ends inside document 0"):
        readers.read_pages(spark, str(tmp_path / "a.json")).collect()


def test_pages_without_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": []}')
    (tmp_path / "b.json").write_text("")
    assert readers.read_pages(spark, f"{tmp_path}/*").count() == 0


def test_a_bulk_file_is_read_once_and_a_damaged_one_is_absent_whole(spark, tmp_path, monkeypatch):
    body = "Code,C\n" + "".join(f"{i},{i % 7}\n" for i in range(60_000))
    whole = gzip.compress(body.encode())
    (tmp_path / "a.csv.gz").write_bytes(whole)
    (tmp_path / "b.csv.gz").write_bytes(whole[:-9])  # all rows are there, the check sum is not
    (tmp_path / "c.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "d.csv").write_text('Code,C,Code\n"1,\n2",,""\n\n3,4\n5,6,7,8\n')
    (tmp_path / "e.csv").write_text("\n")
    load = readers.read_bulk_csv(spark, str(tmp_path))
    assert {p.rsplit("/", 1)[1]: cause.split(":")[0] for p, cause in load.skipped} == {"b.csv.gz": "EOFError", "c.csv.gz": "EOFError", "e.csv": "no header"}
    by_columns = {tuple(f.columns): f for f in load.frames}
    assert by_columns["Code", "C", "_seq"].count() == 60_000
    odd = by_columns["Code", "C", "_column2", "_seq"]
    assert sorted(tuple(r)[:3] for r in odd.collect()) == [("1,\n2", None, ""), ("3", "4", None), ("5", "6", "7")]
    assert "binaryFile" not in odd._jdf.queryExecution().toString()  # rows come from the one pass, staged


def test_many_damaged_files_are_joined_away(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "NAMED_FILES", 1)
    for i in range(4):
        data = gzip.compress(b"Code\n" + f"{i}\n".encode() * 100)
        (tmp_path / f"{i}.csv.gz").write_bytes(data if i == 3 else data[:-4])
    load = readers.read_bulk_csv(spark, str(tmp_path))
    assert len(load.skipped) == 3 and {r.Code for r in load.frames[0].collect()} == {"3"}


def test_files_of_a_store_that_only_spark_reads_are_handed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "STREAMED", set())
    (tmp_path / "a.csv").write_text("Code\n1\n")
    (tmp_path / "a.json").write_text('{"data": [{"Code": "2"}]}')
    assert [r.Code for r in readers.read_bulk_csv(spark, f"{tmp_path}/a.csv").frames[0].collect()] == ["1"]
    assert [r.Code for r in readers.read_pages(spark, f"{tmp_path}/a.json").collect()] == ["2"]
