import base64

from lexloom.operators import export, notes

PART = "doc_id bigint, title string, original string, translated string, digest string"
IMAGE = "doc_id bigint, path string, content binary"


def test_images_are_put_into_pages(spark):
    parts = spark.createDataFrame([(1, "T", "text\n\n![a](./img/a.png)\n\n![b](img/b.jpg)\n\n![c](http://x/c.png)\n\n![d](img/none.gif)", "![a](img/a.png)", None), (2, "U", "no image", None, None), (3, None, None, None, None)], PART)
    images = spark.createDataFrame([(1, "img/a.png", b"aa"), (1, "./img/b.jpg", b"b" * 10), (2, "img/a.png", b"zz"), (1, "img/unseen.png", b"u")], IMAGE)
    got = {r.doc_id: r.html for r in export.compose_html(parts, images=images).collect()}
    assert got[1].count("data:image/png;base64," + base64.b64encode(b"aa").decode()) == 2
    assert "data:image/jpeg;base64," in got[1] and 'src="http://x/c.png"' in got[1] and 'src="img/none.gif"' in got[1]
    assert "base64" not in got[2] and got[3].endswith("</html>")
    chosen = {r.doc_id: {x.path for x in r.images} for r in export.chosen_images(parts, images).collect()}
    assert chosen == {1: {"img/a.png", "img/b.jpg"}}
    assert "base64" not in {r.doc_id: r.html for r in export.compose_html(parts, images=images.limit(0)).collect()}[1]


def test_a_page_has_room_for_so_much():
    images = {"a.png": b"x" * 6, "b.png": b"x" * 5, "c.png": b"x" * 4}
    md = "![](a.png)\n![](b.png)\n![](c.png)"
    assert [("data:" in line) for line in export.Renderer(images, 25, 10).render(md).split("\n")] == [True, False, True]
    assert [("data:" in line) for line in export.Renderer(images, 1, 100).render(md).split("\n")] == [True, False, False]


def test_note_pages_and_changes(spark):
    shape = "name string, body string"
    old = spark.createDataFrame([("a", "# A\n\n**x**"), ("b", None)], shape)
    pages = {r.name: r.html for r in export.note_pages(old).collect()}
    assert "<strong>x</strong>" in pages["a"] and "<title>b</title>" in pages["b"]
    saved = notes.save_notes(old, spark.createDataFrame([("a", "new"), ("c?", "c"), ("c", "b")], shape))
    assert {tuple(r) for r in saved.collect()} == {("a", "new"), ("b", None), ("c", "c")}
    assert [r.name for r in notes.delete_notes(saved, spark.createDataFrame([("a",), ("c",), ("zz",)], "name string")).collect()] == ["b"]
    renames = spark.createDataFrame([("a", "b"), ("a", "d"), ("q", "r"), ("a", "a")], "name string, new_name string")
    told = {(r.name, r.new_name): r.error for r in notes.rename_notes(old, renames).collect()}
    assert told == {("a", "b"): "已存在同名笔记「b」，请换一个名称", ("a", "d"): None, ("q", "r"): "笔记「q」不存在", ("a", "a"): None}
