"""Archive files stay small whatever the captures' sizes, and everything comes back."""

from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

from quillmark.llm import warc


def test_runs_of_large_captures_make_no_large_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", (1000, 10_000, 1 << 31))
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    monkeypatch.setattr(warc, "PER_FILE", 20)
    rows = [(i, f"http://a.example/{i}", "s" * (i % 50)) for i in range(300)]
    rows += [(1000 + i, None, f"{i:05d}" * 1500) for i in range(30)]  # 7500 bytes each, one after the other
    rows += [(2000, "http://b.example/", "x" * 80_000), (2001, "http://b.example/", "x" * 80_000), (2002, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    sizes = [len(gzip.decompress(p.read_bytes())) for p in Path(tmp_path / "w").glob("part-*")]
    assert max(sizes) < 90_000 and sorted(sizes)[-2] < 45_000
    got = {r.page_id: r for r in warc.captures(warc.assemble(warc.read(spark, str(tmp_path / "w")))).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert (got[2000].record_type, got[2000].refers_to, got[2001].record_type) == ("revisit", 2001, "response")
