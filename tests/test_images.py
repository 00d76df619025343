import base64

from pyspark.sql import functions as F
from quire.operators import images


def test_decode_and_names(spark):
    ok = "data:image/jpeg;base64," + base64.b64encode(b"abc").decode()
    df = spark.createDataFrame([(0, "a/b c.png", ok), (1, None, ok), (2, "x", "***"), (3, None, None)], "i int, n string, e string")
    r = df.select("i", images.decoded(F.col("e")).alias("d"), images.safe_image_name(F.col("n"), F.col("i"), F.col("e")).alias("s"), images.save_status(images.decoded(F.col("e"))).alias("st")).orderBy("i").collect()
    assert [x["s"] for x in r] == ["b-c.png", "image-1.jpg", "x.png", "image-3.png"] and [x["st"] for x in r] == ["saved", "saved", "decode_failed", "decode_failed"]
    assert bytes(r[0]["d"]) == b"abc"
    named = spark.createDataFrame([("g", "A.png", 1), ("g", "a.PNG", 2), ("h", "a.png", 3)], "g string, n string, o int")
    assert [x["unique_name"] for x in images.numbered_names(named, "g", "n", "o").orderBy("o").collect()] == ["A.png", "a-2.PNG", "a.png"]
    u = [x["unique_name"] for x in images.unique_names(named, "g", "n", "o").orderBy("o").collect()]
    assert u[0] == "A.png" and len(u[1]) == len("a-12345678.PNG")


def test_images_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (None,), (bytearray(b"y"),)], "content binary")
    for _ in range(2):
        out = images.write_images(images.content_addressed(df, "content"), str(tmp_path / "im")).collect()
    assert len(out) == 2 and len(list((tmp_path / "im").iterdir())) == 2


def test_markdown_matches(spark):
    docs = spark.createDataFrame(
        [("d", "![a cat](img/One.PNG) ![](two.png) ![b](one.png)", [(0, "x/one.png"), (1, "ONE.png")], [("/page/0/Picture/0", "Picture", "shows a cat"), ("/page/0/Text/1", "Text", "two.png")])],
        "object_id string, markdown string, assets array<struct<asset_index:int,name:string>>, blocks array<struct<component_id:string,type:string,text:string>>",
    )
    r = images.match_markdown_images(docs).orderBy("image").collect()
    assert [(x["asset_index"], x["component_id"]) for x in r] == [(0, "/page/0/Picture/0"), (None, None), (1, None)]


def test_tables():
    t = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    big = t(*[[f"w{i}{j}" for j in range(2)] for i in range(60)])
    assert images.replace_tables("a<table>1</table>b<TABLE>2</TABLE>", {1: "X"}) == "a<table>1</table>bX"
    assert images.refinement_accepted(big, big) and not images.refinement_accepted(t(["a"]), t(["a", "b"]))
    assert images.refinement_accepted(big, big.replace("w00", "zz")) and not images.refinement_accepted(t(list("abcdefghij")), t(list("abcdefghix")))
    assert images.refinement_accepted(t(["a", "b"], ["c", "d"]), t(["a", "b"]))
    assert not images.refinement_accepted("no table", t(["a"]))


def test_align_images_by_page_and_names(spark):
    im = "array<struct<src:string,alt:string>>"
    rows = [
        ("d", 0, "/page/0/Image/1", 0, "Image", [("x/A.png", "a  cat")], [("b.png", "A cat"), ("c.png", "dog")]),
        ("d", 1, "/page/0/Image/2", 0, "Image", [], [("b.png", "A cat"), ("c.png", "dog")]),
        ("d", 2, None, 1, "Text", [], [("c.png", "dog")]),
        ("e", 0, "/page/0/Figure/0", 0, "Figure", None, None),
    ]
    figs = spark.createDataFrame(rows, f"object_id string, figure_index int, component_id string, page int, type string, own {im}, shown {im}")
    figs = figs.withColumn("names", images.candidate_names(F.col("own"), F.col("shown"), F.col("type")))
    assert [sorted(r["names"]) for r in figs.orderBy("object_id", "figure_index").collect()] == [["a.png", "b.png"], ["b.png", "c.png"], [], []]
    saved = spark.createDataFrame([("d", 0, 0, "1.png", "B.PNG"), ("d", 1, 0, "2.png", "c.png"), ("d", 2, 1, "3.png", "a.png"), ("f", 0, 0, "x.png", None)], "object_id string, image_index int, page int, name string, original_name string")
    got = {(r["object_id"], r["figure_index"], r["image_index"]): (r["status"], r["source_ref"]) for r in images.align_images(figs, saved).collect()}
    assert got == {("d", 0, 0): ("matched", "/page/0/Image/1"), ("d", 1, 1): ("matched", "/page/0/Image/2"), ("d", 2, None): ("unavailable", "figure:2"), ("d", None, 2): ("unused", None), ("e", 0, None): ("unavailable", "/page/0/Figure/0"), ("f", None, 0): ("unused", None)}
