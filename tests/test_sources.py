"""Document files built in memory: decoding, links, errors, and the same files as a stream."""

import io
import zipfile
import zlib

import pytest

from cvloom.sources import files
from cvloom.sources.sinks import split_errors, write_json
from cvloom.streaming.stream import document_stream, flat_fields, run_pipeline

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, table=(), links=()):
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table)
    rels = "".join(f'<Relationship Id="r{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target="{u}"/>' for k, u in enumerate(links))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{'<w:tbl>' + t + '</w:tbl>' if t else ''}{p}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
    return out.getvalue()


def pdf(pages, links=(), packed=True):
    objs = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids, n = [], 3
    for k, text in enumerate(pages):
        body = b"BT /F1 12 Tf 72 720 Td " + b" ".join(b"(" + ln.replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b") Tj 0 -14 Td" for ln in text.split("\n")) + b" ET"
        raw = zlib.compress(body) if packed else body
        annots = b"/Annots [" + b" ".join(b"<< /Subtype /Link /A << /URI (" + u.encode() + b") >> >>" for u in links) + b"]" if links and k == 0 else b""
        objs[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %s >>" % (n + 1, annots)
        objs[n + 1] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if packed else b"", raw)
        kids.append(b"%d 0 R" % n)
        n += 2
    objs[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % kv for kv in objs.items()) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"


def test_decoders():
    assert files.decode("a.DOCX", docx([" one ", "", "two"], [["c1", "", "c2"]], ["https://x.example/", "mailto:a@b", "https://x.example"]))[:2] == ("one\ntwo\nc1  |  c2", ["https://x.example"])
    for packed in (True, False):
        text, links, error = files.decode("d/b.pdf", pdf(["Ada (x)\nLine 2", " ", "p2"], ["HTTP://y.example/z/"], packed))
        assert (text, links, error) == ("Ada (x)\nLine 2\f\np2", ["HTTP://y.example/z"], None)


def test_filters_of_pdf_streams():
    import base64

    from cvloom.sources import pdf as reader

    raw = b"BT (ab) Tj ET" * 300
    assert reader._hex(raw.hex().encode() + b">") == raw
    assert reader._base85(b"<~" + base64.a85encode(raw) + b"~>") == raw
    assert reader._run_length(bytes([2]) + b"abc" + bytes([255]) + b"x" + bytes([128])) == b"abcxx"
    # an encoder that mirrors the reader: early change of width, emptied when full
    table, out, word, bits, n = {bytes([k]): k for k in range(256)}, [], b"", 0, 258
    codes = [(256, 9)]
    width = 9
    for c in raw:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        codes.append((table[word], width))
        table[word + bytes([c])] = n
        n += 1
        # the reader knows an entry one code later
        width = 9 if n - 1 < 511 else 10 if n - 1 < 1023 else 11 if n - 1 < 2047 else 12
        word = bytes([c])
    codes += [(table[word], width), (257, width)]
    line = "".join(f"{c:0{w}b}" for c, w in codes)
    packed = int(line + "0" * (-len(line) % 8), 2).to_bytes((len(line) + 7) // 8, "big")
    assert reader._lzw(packed) == raw
    assert files.decode("x.pdf", pdf(["text"]).replace(b"/FlateDecode", b"/DCTDecode"))[2] == "Could not read PDF: filter DCTDecode of object 4"


def test_deep_page_trees():
    n = 3_000
    objs = [b"1 0 obj\n<< /Type /Catalog /Pages 10 0 R >>\nendobj"]
    objs += [b"%d 0 obj\n<< /Type /Pages /Kids [%d 0 R] >>\nendobj" % (10 + k, 11 + k) for k in range(n)]
    objs += [b"%d 0 obj\n<< /Type /Page /Contents 5 0 R >>\nendobj" % (10 + n), b"5 0 obj\n<< /Length 14 >>\nstream\nBT (deep) Tj ET\nendstream\nendobj"]
    assert files.decode("x.pdf", b"%PDF-1.4\n" + b"\n".join(objs))[0] == "deep"


def test_text_boxes_are_not_body_text():
    box = "<w:p><w:r><w:t>body</w:t></w:r><w:r><w:pict><w:p><w:r><w:t>floating</w:t></w:r></w:p></w:pict></w:r><w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{box}</w:body></w:document>")
    assert files.decode("x.docx", out.getvalue())[0] == "body link"


def test_single_documents(spark, tmp_path):
    import json

    from cvloom import ParserError, ResumeExtractor, api, extract_profiles, extract_resume

    data = docx(["Grâce Hopper", "grace@x.example", "SKILLS", "Python"], links=["https://github.com/grace-h"])
    (tmp_path / "a.docx").write_bytes(data)
    records = [extract_resume(str(tmp_path / "a.docx")), extract_resume(tmp_path / "a.docx"), extract_resume(data, "CV.DOCX"), ResumeExtractor().extract(io.BytesIO(data), filename="a.docx"), ResumeExtractor.extract_resume(data, filename="a.docx")]
    assert all(r == records[0] for r in records) and list(records[0]) == api.RECORD
    assert (records[0]["name"], records[0]["skills"], records[0]["github"], records[0]["education"]) == ("Grâce Hopper", ["Python"], "https://github.com/grace-h", [])
    text = api.to_json(records[0])
    assert text.isascii() and text.startswith('{\n  "name": ') and json.loads(text) == records[0]
    for source, name, why in ((tmp_path / "no.pdf", None, "File not found"), (data, None, "Could not determine"), (data, "a.txt", "Unsupported file format"), (5, "a.pdf", "Unsupported source type"), (b"no", "a.pdf", "Could not read")):
        with pytest.raises(ParserError, match=why):
            extract_resume(source, name)
    assert extract_profiles("linkedin.com/in/ada-l", ["https://github.com/ada"]) == {"linkedin": "https://linkedin.com/in/ada-l", "github": "https://github.com/ada"}
    rows = files.decode_files(api.sources_frame(spark, [(data, "x.docx"), (str(tmp_path / "no.pdf"), None)])).collect()
    assert [(r.raw_text is not None, r.error) for r in rows] == [(True, None), (False, f"File not found: {tmp_path / 'no.pdf'}")]


def test_errors_are_rows():
    assert files.decode("a.txt", b"x") == (None, [], "Unsupported file format '.txt'")
    assert files.decode("a.d/noname", b"x") == (None, [], "Could not determine the file format")
    for name, data in (("a.pdf", b"not a pdf"), ("a.docx", b"zip?"), ("a.docx", docx([])), ("a.pdf", pdf([" "])), ("a.pdf", None)):
        text, links, error = files.decode(name, data)
        assert text is None and links == [] and error.startswith("Could not read")


def test_batch_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_bytes(pdf(["Ada Lovelace\nada@x.example\nSKILLS\nPython, SQL"], ["https://github.com/ada-l"]))
    (src / "b.docx").write_bytes(docx(["Grace Hopper", "EXPERIENCE", "Software Engineer", "Navy Labs", "2001 - 2002"]))
    (src / "c.pdf").write_bytes(b"broken")
    batch = files.read_documents(spark, str(src))
    good, bad = split_errors(batch)
    assert (good.count(), bad.count()) == (2, 1)
    q = flat_fields(document_stream(spark, str(src))).writeStream.format("memory").queryName("flat").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    rows = {r.path.rpartition("/")[2]: r for r in spark.table("flat").collect()}
    assert (rows["a.pdf"].name, rows["a.pdf"].email, rows["a.pdf"].github, rows["a.pdf"].skills) == ("Ada Lovelace", "ada@x.example", "https://github.com/ada-l", ["Python", "SQL"])
    assert rows["c.pdf"].error.startswith("Could not read") and rows["c.pdf"].skills == []
    run_pipeline(document_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(180)
    got = {r.path.rpartition("/")[2]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [x.job_title for x in got["b.docx"].experience] == ["Software Engineer"]
    write_json(spark.read.parquet(str(tmp_path / "out")), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 3
