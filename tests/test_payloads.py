"""Payload decoding: known vectors, a plain decoder as a check, whole texts."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stateglass.operators import payloads as p
from stateglass.operators.reports import read_report


def slow_fields(data: bytes):
    """The rules of the module, one position after the other."""

    def text_at(at):
        if len(data) - at < 2:
            return None
        body = data[at + 2 : at + 2 + int.from_bytes(data[at : at + 2], "big")]
        size = int.from_bytes(data[at : at + 2], "big")
        fine = all(b in (9, 10, 13) or 0x20 <= b <= 0x7E or 0x80 <= b <= 0xF7 for b in body)
        printable = sum(0x20 <= b <= 0x7E for b in body)
        return body if size and len(body) == size and fine and printable > size // 2 else None

    found, at = [], 0
    while at < len(data):
        left = len(data) - at
        if (body := text_at(at)) is not None:
            found.append(("string", body.decode("utf-8", "replace")))
            at += 2 + len(body)
        elif left >= 12 and text_at(at + 8) is not None:
            found.append(("long", str(int.from_bytes(data[at : at + 8], "big", signed=True))))
            at += 8
        elif left >= 4:
            found.append(("int", str(int.from_bytes(data[at : at + 4], "big", signed=True))))
            at += 4
        else:
            found.append(("hex", data[at:].hex()))
            break
    return found if len(data) >= 4 and len(found) >= 2 else None


def fast_fields(payloads):
    found = p._field_array(pa.array(payloads, pa.binary())).to_pylist()
    return [r and [(f["type"], f["text"]) for f in r] for r in found]


VECTORS = [
    ("00000023 0005 68656c6c6f 00000063", [("int", "35"), ("string", "hello"), ("int", "99")]),
    (
        "0000000000000023 000d 73747265616d2d6576656e7473 00000003 000000000000067c",
        [("long", "35"), ("string", "stream-events"), ("int", "3"), ("int", "0"), ("int", "1660")],
    ),
    ("0102", None),
    ("cafebabe", None),
    ("", None),
    ("ffffffff 00000001 ff", [("int", "-1"), ("int", "1"), ("hex", "ff")]),
]


@pytest.mark.parametrize("given_hex, expected", VECTORS)
def test_vectors(given_hex, expected):
    data = bytes.fromhex(given_hex)
    assert fast_fields([data]) == [expected]
    assert slow_fields(data) == expected


# Short lengths and text are frequent, so that strings do come up.
pieces = st.one_of(
    st.binary(max_size=9),
    st.text(max_size=12).map(lambda s: len(s.encode()).to_bytes(2, "big") + s.encode()),
    st.integers(-(2**63), 2**63 - 1).map(lambda n: n.to_bytes(8, "big", signed=True)),
    st.integers(0, 40).map(lambda n: n.to_bytes(4, "big")),
)


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.lists(pieces, max_size=6).map(b"".join)), max_size=40),
    st.sampled_from([1, 16, 10_000]),
    st.sampled_from([8, 50, 4 << 20]),
)
def test_same_as_plain_decoder(payloads, together, group_bytes):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(p, "TOGETHER", together)
        patch.setattr(p, "GROUP_BYTES", group_bytes)
        assert fast_fields(payloads) == [slow_fields(x or b"") for x in payloads]


def test_slice_of_an_array():
    column = pa.array([b"\0\0\0\1\0\0\0\2", None, b"\0\0\0\3\0\0\0\4", b"\1"], pa.binary())
    found = p._field_array(column.slice(1, 3)).to_pylist()
    assert [r and [f["text"] for f in r] for r in found] == [None, ["3", "4"], None]
    assert p._layout_array(column.slice(1)).to_pylist() == [None, "int*2", None]
    assert p._field_array(column.slice(4)).to_pylist() == []


def test_text_that_is_not_utf8():
    data = b"\0\5ab\xc3cd\0\0\0\1"
    assert fast_fields([data]) == [slow_fields(data)] == [[("string", "ab\ufffdcd"), ("int", "1")]]


def test_job_over_partitions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        kind = rng.randrange(3)
        name = f"name-{rng.randrange(10**6)}".encode()
        data = [
            i.to_bytes(8, "big") + len(name).to_bytes(2, "big") + name + i.to_bytes(4, "big"),
            bytes([1, 2]),
            rng.randbytes(rng.randrange(60)),
        ][kind]
        rows.append((i, bytearray(data) if i % 50 else None))
    frame = spark.createDataFrame(rows, "id int, payload binary").repartition(7)
    found = {r["id"]: r for r in p.decode_payloads(frame, "payload").collect()}
    assert len(found) == 500
    for i, data in rows:
        expected = slow_fields(bytes(data or b""))
        row = found[i]
        if expected is None:
            assert row["fields"] is None
            assert (row["raw"] is None) == (data is None)
        else:
            assert [(f["type"], f["text"]) for f in row["fields"]] == expected
            assert [f["pos"] for f in row["fields"]] == list(range(len(expected)))
            assert row["raw"] is None


def test_long_payloads_are_read_whole(spark, monkeypatch):
    body = b"x" * 300
    data = b"".join(len(body).to_bytes(2, "big") + body for _ in range(2000))
    frame = spark.createDataFrame([(bytearray(data),)], "payload binary")
    assert p.decode_payloads(frame, "payload").select(F.size("fields")).first()[0] == 2000
    layout = p.payload_layouts(frame, "payload").first()["layout"]
    assert layout == "string*2000"


def test_layouts_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.col("text").cast("binary").alias("payload"))
    found = {(r["lang"], r["layout"]): r for r in p.layout_profile(docs, "payload", ["lang"]).collect()}
    expected = {}
    for lang, data in docs.collect():
        fields, runs = slow_fields(bytes(data)), []
        for kind, _ in fields or []:
            if runs and runs[-1][0] == kind:
                runs[-1][1] += 1
            else:
                runs.append([kind, 1])
        layout = ",".join(k if n == 1 else f"{k}*{n}" for k, n in runs) or "raw"
        expected[(lang, layout)] = expected.get((lang, layout), 0) + 1
    assert {k: r["n_rows"] for k, r in found.items()} == expected
    shares = {}
    for (lang, _), row in found.items():
        shares[lang] = shares.get(lang, 0) + row["share"]
    assert all(s == pytest.approx(1) for s in shares.values())


def test_report(spark):
    rows = [("a", bytearray(b"\x01\x02")), ("a", bytearray(8)), ("b", bytearray(8))]
    frame = spark.createDataFrame(rows, "operator_uid string, payload binary")
    found = {r["operator_uid"]: tuple(r)[1:] for r in read_report(p.decode_payloads(frame, "payload")).collect()}
    assert found == {"a": (2, 1, p.NOT_DECODED, True), "b": (1, 0, "", False)}
