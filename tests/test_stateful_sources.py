"""Harvests over tokens that expire and readers that are killed, and archives of arrays that lie."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import numpy as np
import pytest

from tessera.sources import arrays
from tessera.streaming import harvest

NS = "http://www.openarchives.org/OAI/2.0/"


class Service:
    """A list of records in pages; a token may be refused a number of times, and a page may fail for good until it is mended."""

    def __init__(self, n=23, per=5):
        self.n, self.per, self.refuse, self.dead, self.asked = n, per, {}, set(), []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                token = parse_qs(urlsplit(self.path).query).get("resumptionToken", ["0"])[0]
                outer.asked.append(token)
                if token in outer.dead or outer.refuse.get(token, 0) > 0:
                    outer.refuse[token] = outer.refuse.get(token, 0) - 1
                    self.send_error(404 if token in outer.dead else 400)
                    return
                at = int(token)
                rows = "".join(f"<record><header><identifier>id{k}</identifier></header><metadata><m:t xmlns:m='x'>title\n  {k}</m:t></metadata></record>" for k in range(at, min(at + outer.per, outer.n)))
                after = str(at + outer.per) if at + outer.per < outer.n else ""
                body = f"<OAI-PMH xmlns='{NS}'><ListRecords>{rows}<resumptionToken completeListSize='{outer.n}'>{after}</resumptionToken></ListRecords></OAI-PMH>".encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.first = f"http://127.0.0.1:{self.server.server_port}/oai?verb=ListRecords&set=math"


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_harvest_reads_every_page(spark, service, tmp_path):
    got = harvest.harvest(spark, service.first, f"{tmp_path}/out", f"{tmp_path}/state")
    assert ids(got) == sorted(f"id{k}" for k in range(23)) and {r["page"] for r in got.collect()} == {1, 2, 3, 4, 5}
    titles = {r["id"]: r["title"] for r in harvest.papers(got, {"title": "//t"}).collect()}
    assert titles["id7"] == "title 7"


def test_harvest_survives_a_token_that_expires(spark, service, tmp_path):
    service.refuse["10"] = 1
    got = harvest.harvest(spark, service.first, f"{tmp_path}/out", f"{tmp_path}/state")
    assert ids(got) == sorted(f"id{k}" for k in range(23)) and service.asked.count("0") >= 2


def test_a_killed_harvest_goes_on(spark, service, tmp_path):
    service.dead.add("15")
    with pytest.raises(Exception, match="404"):
        harvest.harvest(spark, service.first, f"{tmp_path}/out", f"{tmp_path}/state", tries=1)
    held = ids(spark.read.parquet(f"{tmp_path}/out"))
    assert 10 <= len(held) <= 15
    service.dead.clear()
    service.refuse["15"] = 1  # and the token has expired meanwhile
    got = harvest.harvest(spark, service.first, f"{tmp_path}/out", f"{tmp_path}/state")
    assert ids(got) == sorted(f"id{k}" for k in range(23))


def test_a_batch_that_runs_again_is_read_again(service):
    reader = harvest.HarvestReader(service.first)
    rows, after = reader.read(reader.initialOffset())
    first = list(rows)
    assert [r[0] for r in first] == [f"id{k}" for k in range(5)] and list(reader.readBetweenOffsets(reader.initialOffset(), after)) == first
    second, end = reader.read(after)
    service.refuse["5"] = 1
    again = {r[0] for r in reader.readBetweenOffsets(after, end)}
    assert {r[0] for r in second} <= again
    assert list(reader.read({"url": None, "page": 9})[0]) == []


def archive(root, rows=(7, 0, 5), dim=3, **change):
    """An archive of numbered rows; change: chunk -> bytes that replace it."""
    root.mkdir(parents=True, exist_ok=True)
    at, chunks = 0, []
    for k, n in enumerate(rows):
        a = np.arange(at * dim, (at + n) * dim, dtype=[np.float32, np.float64][k % 2]).reshape(n, dim)
        np.save(root / f"c{k}.npy", np.asfortranarray(a) if k == 2 else a)
        chunks.append({"filename": f"c{k}.npy", "rows": n, "sha256": hashlib.sha256((root / f"c{k}.npy").read_bytes()).hexdigest()})
        at += n
    (root / "vector-manifest.json").write_text(json.dumps({"dimension": dim, "records": at, "chunks": chunks, **change}, indent=1))
    return chunks


def test_array_rows_come_in_order(spark, tmp_path):
    archive(tmp_path / "a")
    got = sorted((r["idx"], r["vec"]) for r in arrays.array_rows(spark, str(tmp_path / "a")).collect())
    assert got == [(k, [3.0 * k, 3.0 * k + 1, 3.0 * k + 2]) for k in range(12)]
    assert arrays.array_faults(spark, str(tmp_path / "a")).count() == 0


def test_array_archives_that_lie_are_refused(spark, tmp_path):
    def broken(name, act, match):
        root = tmp_path / name
        chunks = archive(root)
        act(root, chunks)
        with pytest.raises(Exception, match=match):
            arrays.array_rows(spark, str(root)).collect()

    def seal(root, chunks):
        chunks[0]["sha256"] = hashlib.sha256((root / "c0.npy").read_bytes()).hexdigest()
        (root / "vector-manifest.json").write_text(json.dumps({"dimension": 3, "records": 12, "chunks": chunks}))

    def short(root, chunks):
        data = (root / "c0.npy").read_bytes()
        (root / "c0.npy").write_bytes(data[:-4])
        seal(root, chunks)

    def flip(root, _):
        data = bytearray((root / "c2.npy").read_bytes())
        data[-1] ^= 1
        (root / "c2.npy").write_bytes(data)

    def fewer(root, chunks):
        np.save(root / "c0.npy", np.zeros((6, 3), np.float32))
        seal(root, chunks)

    broken("gone", lambda root, _: (root / "c2.npy").unlink(), "missing chunk: c2.npy")
    broken("flipped", flip, "changed chunk: c2.npy")
    broken("short", short, "80 bytes|bytes for")
    broken("fewer", fewer, "the manifest says")
    broken("sum", lambda root, c: archive(root, records=13), "hold 12 rows of 13")
    faults = {r["filename"]: r["fault"] for r in arrays.array_faults(spark, str(tmp_path / "flipped")).collect()}
    np.save(tmp_path / "gone" / "c9.npy", np.zeros(1))
    faults |= {r["filename"]: r["fault"] for r in arrays.array_faults(spark, str(tmp_path / "gone")).collect() if r["filename"] == "c9.npy"}
    assert faults == {"c2.npy": "changed", "c9.npy": "unlisted"}
