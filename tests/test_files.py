"""Files as a user has them: plain folders, several encodings, saved content
lists with unknown keys, several files of one stem."""

import json

import pytest

from maskloom.operators import jobs
from maskloom.sources import files as FS

SALT = "s"


def _folder(tmp_path, contents):
    for name, content in contents.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path)


def _name(path):
    return path.rsplit("/", 1)[1]


def test_folder_of_text_files(spark, tmp_path):
    folder = _folder(tmp_path, {
        "a.txt": "last line\n", "sub/a.MD": "one\r\ntwo\rthree", "gbk.txt": "电话".encode("gbk"), "latin.md": b"caf\xe9\xff",
        "notes_txt": "no dot", "empty.txt": "", "scan.pdf": "%PDF", "my txt.docx": "office", "mdx.bin": "unknown",
    })
    items = {_name(r.path): r for r in FS.scan_text_files(FS.read_text_files(spark, folder)).collect()}
    assert {k: r.text for k, r in items.items()} == {
        "a.txt": "last line\n", "a.MD": "one\ntwo\nthree", "gbk.txt": "电话", "latin.md": "caféÿ", "notes_txt": "no dot",  # Spark lists no empty files
    }
    assert {(r.item_idx, r.type, r.title) for r in items.values()} == {(0, "text", None)}
    encodings = {_name(r.path): r.encoding for r in FS.decode_bytes(FS.read_text_files(spark, folder)).collect()}
    assert encodings["gbk.txt"] == "gbk" and encodings["latin.md"] == "latin-1" and encodings["a.txt"] == "utf-8"


LIST = [
    {"type": "title", "title": "Mail x@y.com", "text_level": 1},
    {"type": "text", "text": "call 13812345678 or x@y.com", "page": 3, "bbox": [1, 2.5, None], "note": None},
    {"img_path": "a.png", "type": "image", "caption": {"text": "x@y.com"}},
    {"type": "text", "text": None}, {"type": "text", "text": ""}, {"type": "text", "text": 5},
]


def test_saved_content_lists_keep_everything(spark, tmp_path):
    folder = _folder(tmp_path / "in", {"r_content_list.json": json.dumps(LIST), "d/r_content_list.json": json.dumps(LIST[:1], indent=2), "e.json": "[]"})
    items = FS.scan_content_list(FS.read_files(spark, folder, "*.json"))
    out, back = str(tmp_path / "out"), str(tmp_path / "back")
    _, vault = jobs.mask_files(items, SALT, out)
    rows = FS.read_outputs(spark, out, "lists").collect()
    assert [r.out_name for r in rows] == ["r_content_list_masked_content_list.json"] * 2  # one stem, two documents
    masked = {r.path.rsplit("/", 2)[1]: json.loads(r.content) for r in rows}
    mail = masked["in"][0]["title"].removeprefix("Mail ")
    assert mail.startswith("__MASKED_email_") and masked["d"][0]["title"] == f"Mail {mail}"
    assert mail in masked["in"][1]["text"] and "138" not in masked["in"][1]["text"]
    for got, item in zip(masked["in"], LIST, strict=True):
        assert list(got) == list(item)
        assert {k: v for k, v in got.items() if k not in ("text", "title")} == {k: v for k, v in item.items() if k not in ("text", "title")}
    assert [i["text"] for i in masked["in"][3:]] == [None, "", 5]
    jobs.unmask_files(items, FS.scan_content_list(FS.read_outputs(spark, out, "lists")), vault, back)
    restored = {r.path.rsplit("/", 2)[1]: json.loads(r.content) for r in FS.read_outputs(spark, back, "lists").collect()}
    assert restored == {"in": LIST, "d": LIST[:1]}
    markdown = {r.path.rsplit("/", 2)[1]: r.content for r in FS.read_outputs(spark, back, "markdown").collect()}
    assert markdown["d"] == "# Mail x@y.com\n\n" and "call 13812345678 or x@y.com\n\n" in markdown["in"]


def test_files_of_one_stem_stay_apart(spark, tmp_path):
    folder = _folder(tmp_path / "in", {"a.txt": "x@y.com", "a.md": "p@q.com", "b/a.txt": "10.0.0.1"})
    items = FS.scan_text_files(FS.read_text_files(spark, folder))
    out, back = str(tmp_path / "out"), str(tmp_path / "back")
    _, vault = jobs.mask_files(items, SALT, out)
    saved = FS.scan_content_list(FS.read_outputs(spark, out, "lists").where("path not like '%/b/%'"))
    jobs.unmask_files(items, saved, vault, back)
    got = sorted((r.path.split("/in/")[1], r.out_name, r.content) for r in FS.read_outputs(spark, back, "markdown").collect())
    assert got == [("a.md", "a_unmasked.md", "p@q.com\n\n"), ("a.txt", "a_unmasked.md", "x@y.com\n\n"), ("b/a.txt", "a_unmasked.md", "10.0.0.1\n\n")]


def test_a_broken_content_list_ends_the_job(spark):
    lists = spark.createDataFrame([("/in/a.json", '[{"text": '), ("/in/b.json", None)], "path string, content string")
    assert FS.scan_content_list(lists.where("content is null")).count() == 0
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        FS.scan_content_list(lists).collect()
