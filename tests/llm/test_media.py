import hashlib
import io
import tarfile
import zlib
from collections import defaultdict

from llm_cases import ODD, documents

from motionspark.llm.media import features, from_png, media_columns, op9_media, padded, to_png


def test_round_trip_of_images():
    for text in ("", "x", "y" * 192, "z" * 193, "é🙂" * 999):
        payload = padded(text.encode())
        assert len(payload) % 192 == 0 and payload.rstrip(b" ") == text.encode().rstrip(b" ")
        assert from_png(to_png(payload)) == payload


def test_rows_and_shards(spark):
    rows = media_columns(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    key = lambda i, n: (repr(i), n)
    want = sorted((*key(i, len((t or "").encode())), hashlib.sha256(padded((t or "").encode())).hexdigest(), zlib.crc32(padded((t or "").encode())[-16:])) for i, t, _ in ODD)
    assert sorted((*key(r.doc_id, r.n_bytes), r.payload_sha256, r.tail_crc32) for r in rows) == want
    same = defaultdict(set)
    for r in rows:
        assert (r.width, r.height * r.width, r.bits) == (192, r.payload_bytes, 8)
        assert r.payload == r.payload_sha256
        same[r.payload].add((r.media_sha256, r.media_bytes, r.feature, r.shard, r.offset))
    assert all(len(v) == 1 for v in same.values())
    # The shards are plain tar files, and offset and length are those of the stored image.
    for shard in {r.shard for r in rows}:
        data = open(shard, "rb").read()
        files = {m.offset_data: (m.name, m.size) for m in tarfile.open(fileobj=io.BytesIO(data)).getmembers()}
        for r in rows:
            if r.shard == shard:
                assert files[r.offset] == (f"{r.payload}.png", r.length)
                assert hashlib.sha256(data[r.offset : r.offset + r.length]).hexdigest() == r.media_sha256


def brute_feature(payload):
    rows = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    mean = sum(payload) / len(payload)
    dev = (sum((b - mean) ** 2 for b in payload) / len(payload)) ** 0.5
    bits = ""
    for k in range(8):
        a, b = int(len(rows) * k / 8), int(len(rows) * (k + 1) / 8)
        band = rows[a : max(b, a + 1)]
        cells = [sum(sum(r[c * 24 : c * 24 + 24]) / 24 for r in band) / len(band) for c in range(8)]
        bits += "".join(str(int(cells[c] > cells[c - 1])) for c in range(8))
    return mean, dev, int(bits, 2)


def test_features():
    for text in ("", "x", "hello world " * 40, "é🙂" * 999, "A" * 192 + "b" * 192 * 11):
        payload = padded(text.encode())
        shape, mean, dev, bits = features(payload, 192).split(":")
        m, d, b = brute_feature(payload)
        assert shape == f"192x{len(payload) // 192}" and abs(float(mean) - m) < 1e-3 and abs(float(dev) - d) < 1e-3 and int(bits, 16) == b


def test_every_document(spark):
    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9_media(spark, folder).collect()
    assert len(rows) == len(text)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        payload = padded(data)
        image = to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), features(payload, 192))
