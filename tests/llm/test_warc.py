import gzip
import hashlib
import io
import os

import numpy as np
import pytest

from cairnflow.llm import warc as W

PAGES = "page_id long, url string, html string, payload string"


@pytest.mark.parametrize("step", [37, 500, 1 << 20])
def test_each_record_has_one_range(step):
    rng = np.random.default_rng(0)
    made = []
    for i in range(40):
        body = rng.integers(0, 256, int(rng.integers(0, 900))).astype(np.uint8).tobytes() + W.MAGIC * 3 + gzip.compress(b"WARC/ but no record")
        made.append(W._member(W.record(i, "u", body, hashlib.sha1(body).digest(), None, False)))
    data = b"junk" + made[0] + b"".join(made[1:20]) + b"\x1f\x8b\x08 broken" + b"".join(made[20:])
    found = [at for low in range(0, len(data), step) for at, _, _ in W.records_of_range(io.BytesIO(data), len(data), low, min(len(data), low + step))]
    starts, at = [], 4
    for i, m in enumerate(made):
        at += len(b"\x1f\x8b\x08 broken") if i == 20 else 0
        starts.append(at)
        at += len(m)
    assert found == starts


def test_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 600 + "</p>"
    rows = [(i, f"http://x/{i}\r\n", long + str(i % 4), "clash") for i in range(40)] + [(100 + i, "u", "short", None) for i in range(5)]
    rows += [(200, None, None, None), (201, "", "", ""), (None, "u", "z" * 2000, None), (None, "u", long + "0", None), (300, "u", "y" * 3_000_000, None), (400, "u", "q" * 1000, None), (400, "u", "q" * 1000, None), (399, "u", "q" * 1000, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = W.write_archives(pages, f"file://{tmp_path}/warc")
    assert sum(r.records for r in manifest.collect()) == len(rows)
    assert all(os.path.getsize(r.path.removeprefix("file://")) == r.bytes for r in manifest.collect())
    last = {}
    for page, _, html, _ in rows:
        last[html] = max(last.get(html) or -1, page if page is not None else -1)
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and last[html] >= 0 and page != last[html]
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[html] if again else None, None if again else data))
    for size in (700, W.RANGE_BYTES):
        got = W.read_archives(manifest, range_bytes=size).collect()
        tell = lambda x: sorted(map(str, x))
        assert tell((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == tell(want)


def test_empty(spark, tmp_path):
    assert W.read_archives(W.write_archives(spark.createDataFrame([], PAGES), str(tmp_path))).collect() == []
