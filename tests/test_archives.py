"""Archives read member by member."""

import zipfile

import pytest

from ledgerlake.sources import archives


def test_members_are_partitions(spark, tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(3):
                z.writestr(f"m{m}.csv", f"CRD,Name,CRD\n{a}{m},\xc9lan,x\n\n{a}{m}1,\"a, \"\"b\"\"\nc\"\n".encode("latin-1"))
            z.writestr("empty.csv", "")
            z.mkdir("folder")
    rows = archives.zipped_csv(spark, str(tmp_path / "*.zip"), {"Name": "name", "CRD": "crd", "Other": "other"}, members="m*.csv")
    assert rows.rdd.getNumPartitions() == 6
    got = sorted((r["file"][-5:], r["member"], r["number"], r["crd"], r["name"], r["other"]) for r in rows.collect())
    want = [(f"{a}.zip", f"m{m}.csv", i, f"{a}{m}{'1' * i}", ("Élan", 'a, "b"\nc')[i], None) for a in range(2) for m in range(3) for i in range(2)]
    assert got == want
    assert archives.zipped_csv(spark, str(tmp_path), {"Name": "n"}, members="empty*").count() == 0
    assert archives.zipped_csv(spark, str(tmp_path), {"Name": "n"}, members="nothing*").count() == 0
    with pytest.raises(ValueError):
        archives.zipped_csv(spark, str(tmp_path), {"CRD": "member"})


def test_long_members(spark, tmp_path):
    lines = [f"line {i}" for i in range(archives.BATCH * 2 + 1)] + ["x" * 1_000_000, "", "end"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "\r\n".join(lines))
        z.writestr("b.csv", "k,v\n" + "\n".join(f'{i},"{"y" * 300_000 if i == 7 else i}"' for i in range(archives.BATCH + 5)))
    rows = archives.zipped_text(spark, str(tmp_path), members="*.txt")
    assert [r["line"] for r in rows.orderBy("number").collect()] == lines and [r["number"] for r in rows.orderBy("number").collect()] == list(range(len(lines)))
    got = archives.zipped_csv(spark, str(tmp_path / "a.zip"), {"v": "v"}, members="b.csv")
    assert got.count() == archives.BATCH + 5 and got.selectExpr("max(length(v))").first()[0] == 300_000


def test_not_an_archive(spark, tmp_path):
    (tmp_path / "a.zip").write_text("no archive")
    with pytest.raises(Exception, match="not a zip file"):
        archives.zipped_text(spark, str(tmp_path)).collect()
