import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from sedgetable.llm import warc, words, wrappers

HTML = ["<p>one</p>" * 50, "<p>two é</p>", "<p>two é</p>", "", None, "<p>one</p>" * 50, "x" * 300_000, "<p>two é</p>"]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    last = {}
    for k, h in rows:
        if len((h or "").encode()) >= min_bytes:
            last[digest(h)] = max(k, last.get(digest(h), k))
    return sorted((k, len((h or "").encode()), digest(h), "response" if last.get(digest(h), k) == k else "revisit", None if last.get(digest(h), k) == k else last[digest(h)]) for k, h in rows)


@pytest.mark.parametrize(("archive_bytes", "min_bytes"), [(32 << 20, 0), (700, 0), (700, 20)])
def test_archives_come_back(spark, monkeypatch, archive_bytes, min_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    rows = list(enumerate(HTML))
    df = spark.createDataFrame([(k, f"http://a.example/{k} x\r\ny", h) for k, h in rows], "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).repartition(2)
    archives = warc.write(df, words.shared_path(spark, "warc"), min_bytes=min_bytes)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read(spark, archives).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back) == expected(rows, min_bytes)
    assert all(bytes(r["payload"]) == (HTML[r["page_id"]] or "").encode() for r in back if r["record_type"] == "response")


def test_layout_of_an_archive():
    records = [warc.record(k, f"http://a/{k}", f"<html>{k} some page text</html>".encode() * 20, None, "2024-01-01T00:00:00Z") for k in range(300)]
    data = warc.archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert held.dict_id() != 0
    first = zstandard.ZstdDecompressor(dict_data=held).decompressobj().decompress(data[8 + size :])
    assert first == records[0]
    assert list(warc.frames(io.BytesIO(data))) == records
    assert len(data) < sum(map(len, records)) / 4
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-3])))


def test_round_trip_edges(spark):
    rows = [(None, None, "a"), (None, "u", "a"), (7, "u", "a"), (7, "u", "a"), (8, None, None)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 5 and all(r["record_type"] == "response" for r in out)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{a:b}}</style><script>var t="</p>";</script></head><body>
<nav><ul>{links}</ul></nav><div class="ad">buy {n}</div><article><h1>Title {n}</h1><p><b>First {n} &amp; more<br><p>Second  \n{n} &lt;i&gt; <i>wo</i>rd
{extra}</p><form><input value="x">send</form><div class="comments"><p>a reader says {n}</p></div></article><aside>side {n}</aside><footer>&copy; me</footer></body></html>"""


def page(n, extra=""):
    return PAGE.format(n=n, extra=extra, links="".join(f'<li><a href="/{k}">l{k}</a></li>' for k in range(n % 3 + 1)))


def test_article_without_its_surroundings():
    texts = wrappers.extracted([page(n, "<ul><li>x<li>y</ul>" if n % 2 else "") for n in range(6)])
    for n, t in enumerate(texts):
        assert t == f"Title {n}\nFirst {n} & more\nSecond {n} <i> word" + ("\nx\ny" if n % 2 else "")


def test_unnamed_article_is_where_the_slots_are():
    shell = '<body><div class="top-menu">m</div><div id="w"><div class="x"><h2>Head {n}</h2><p>body text {n} {more}</p><p>end {n}</p></div><div class="sidebar"><p>long side text {n}</p></div></div><div>fixed words of the site</div></body>'
    texts = wrappers.extracted([shell.format(n=n, more=f"word{n} " * 20) for n in range(4)])
    assert texts[2] == "Head 2\nbody text 2 " + " ".join(["word2"] * 20) + "\nend 2"


def test_wrapper_is_union_free_and_general():
    a, b = '<div><h1>x</h1><p>1</p><p>2</p><hr></div>', "<div><h1>y</h1><p>1</p><b>z</b></div>"
    wrapper = wrappers.aligned(wrappers.wrapper_of(wrappers.parsed(a).content), wrappers.parsed(b).content)
    assert wrappers.expression(wrapper) == "<div><h1>#</h1>(<p>#</p>)+(<hr></hr>)?(<b>z</b>)?</div>"


def test_broken_pages():
    sources = ["", "<", "<p", "no tags at all", "<div>" * 5000 + "deep", "<article>a<!-- x", "<article>cut &am", "</div></p>x", '<article><p title="a>b">q</p>', "<ARTICLE><P>up</P></ARTICLE>", "a<br>" + "x<b>y</b><i>q</i>" * 3000]
    texts = [wrappers.extracted([s])[0] for s in sources]
    assert texts[:10] == ["", "<", "", "no tags at all", "deep", "a", "cut &am", "x", "q", "up"]
    assert len(wrappers.extracted(sources)) == len(sources)


def test_main_texts_rows(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "GROUP_PAGES", 3)
    rows = [(n, f"http://{'busy' if n % 4 else 'calm'}.example/{n}", page(n)) for n in range(30)] + [(30, None, page(30)), (31, "http://busy.example/", None), (5, "http://busy.example/5", page(5)), (None, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    out = wrappers.main_texts(df).collect()
    want = {(k, u): wrappers.extracted([h or ""])[0] for k, u, h in rows}
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in out) == sorted((str(k), str(u), want[k, u], len(want[k, u])) for k, u, _ in rows)
    assert wrappers.main_texts(df.limit(0)).count() == 0
