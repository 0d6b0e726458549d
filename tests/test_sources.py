import pytest
from pyspark.sql import functions as F

from folioforge.sources import texts

CHINESE = "第一章 起风了\n夜色渐深，他没有回头，只是把那封信折好，放进了抽屉里。" * 3


@pytest.mark.parametrize(
    ("raw", "encoding", "reason", "blocked"),
    [
        (CHINESE.encode(), "utf-8", "strict_utf8", None),
        (b"\xef\xbb\xbf" + CHINESE.encode(), "utf-8-sig", "bom", None),
        (b"\xff\xfe" + CHINESE.encode("utf-16-le"), "utf-16-le", "bom", None),
        (CHINESE.encode("gb18030"), "gb18030", "quality_score", None),
        (b"\xff\xfe\x00\x00a", None, None, "unsupported_bom"),
        (bytes.fromhex("a440"), None, None, "ambiguous_strict_decoding"),
        (bytes.fromhex("813081"), None, None, "no_strict_decoder"),
        (bytes.fromhex("ffff80"), None, None, "no_strict_decoder"),
        ("a\x01b".encode(), None, None, "disallowed_control_character"),
        (b"   ", None, None, "low_text_quality"),
    ],
)
def test_decoding(raw, encoding, reason, blocked):
    got = texts.decode_one(raw)
    assert got[1:3] + got[5:] == (encoding, reason, blocked)


def test_raw_books(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(CHINESE.encode("gb18030"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfplain")
    (tmp_path / "c.md").write_bytes(b"no")
    rows = texts.raw_books(spark, str(tmp_path)).withColumn("d", texts.decoded(F.col("content"))).withColumn("mark", texts.byte_order_mark(F.col("content")))
    got = {r.name: (r.d.encoding, r.d.text, r.mark) for r in rows.collect()}
    assert got == {"a.txt": ("gb18030", CHINESE, None), "b.txt": ("utf-8-sig", "plain", "utf-8-sig")}
