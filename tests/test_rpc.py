"""The JSON-RPC log source against a small node on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomstream.cli import main
from loomstream.sources.logs import decode_logs
from loomstream.sources import ingest, segments
from loomstream.sources.rpc import Meter, Node, RangeRefused, RpcError, RpcLogs, Verdict, verdict

TOKEN, TOPIC = "0x" + "AB" * 20, "0x" + "11" * 32


class Chain(BaseHTTPRequestHandler):
    """Two transfers a block; serves 100 blocks at once; every 7th request finds it busy; block 666 does not exist."""

    asked, lost, limited = 0, set(), []

    def do_POST(self):  # noqa: N802
        call = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Chain.asked += 1
        out, status = {}, 200
        if Chain.asked % 7 == 0:
            status = 429
        elif call["method"] == "eth_getLogs":
            a, b = (int(call["params"][0][k], 16) for k in ("fromBlock", "toBlock"))
            Chain.limited.append((a, b))
            if any(a <= n <= b for n in Chain.lost):
                out, status = {"error": {"code": -32000, "message": "no such data"}}, 200
            elif b - a >= 400:
                out, status = {"error": {"code": -32614, "message": "eth_getLogs is limited to a 2,000 range"}}, 413
            elif b - a >= 100:
                out, status = {"error": {"code": -32602, "message": "block range is too wide: block range limit"}}, 400
            else:
                out = {"result": [{"address": TOKEN, "blockNumber": hex(n), "logIndex": hex(i), "transactionHash": f"0x{n:064x}", "topics": [TOPIC, f"0x{n:064x}", f"0x{i:064x}"], "data": f"0x{n:064x}", **({"blockTimestamp": hex(n * 2)} if i else {})} for n in range(a, b + 1) for i in range(2)]}
        elif call["method"] == "eth_getBlockByNumber":
            n = int(call["params"][0], 16)
            out = {"result": None if n == 666 else {"timestamp": hex(n * 2)}}
        elif call["method"] == "eth_chainId":
            out = {"result": "0x1"}
        else:
            out = {"error": {"code": -32601, "message": "no such method"}}
        body = json.dumps({"jsonrpc": "2.0", "id": 1} | out).encode() if out else b"busy"
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Chain)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def test_each_block_once(url):
    meter = Meter(700)
    runs = list(Node(url, wait=0).chunks(TOKEN, [TOPIC], 1000, 2399, meter))
    assert [int(x["blockNumber"], 16) for run in runs for x in run] == [n for n in range(1000, 2400) for _ in range(2)]
    assert meter.width() <= 200


@pytest.mark.parametrize(
    ("said", "what"),
    [
        ((413, -32614, "eth_getLogs is limited to a 2,000 range"), Verdict.RANGE), ((500, -32020, "backend response too large"), Verdict.RANGE), ((200, -32000, "query returned more than 10000 results"), Verdict.RANGE),
        ((429, -32016, "over rate limit"), Verdict.BUSY), ((200, -32005, "limit exceeded"), Verdict.BUSY), ((503, None, ""), Verdict.BUSY), ((200, -32601, "no such method"), Verdict.FINAL), ((404, None, ""), Verdict.FINAL),
    ],
)
def test_errors_are_told_apart(said, what):
    assert verdict(*said) is what


def test_a_refused_range_is_not_asked_twice(url):
    Chain.limited.clear()
    with pytest.raises(RangeRefused) as refused:
        Node(url, wait=0).logs(TOKEN, [TOPIC], 0, 5000)
    assert refused.value.code == -32614 and Chain.limited.count((0, 5000)) == 1


def test_final_errors(url):
    with pytest.raises(RpcError, match="no such method"):
        Node(url, wait=0).call("unknown", [])
    with pytest.raises(RpcError, match="missing"):
        Node(url, wait=0).block_time(hex(666))
    with pytest.raises(RpcError, match="tries failed"):
        Node("http://127.0.0.1:9", wait=0, tries=2).call("eth_chainId", [])


def test_meter():
    meter = Meter(200)
    assert meter.width() == 200
    meter.declined(200)
    meter.answered(100, 0)
    assert meter.width() == 199
    for _ in range(Meter.PATIENCE):
        meter.answered(100, 10_000)
    assert 45 <= meter.width() <= 55
    meter.declined(1)
    assert meter.width() == 1


def test_source(spark, url):
    spark.dataSource.register(RpcLogs)
    logs = spark.read.format("rpc_logs").options(url=url, address=TOKEN, topic=TOPIC, start="1000", end="1049", segment_blocks="20", chunk_blocks="15", wait="0").load()
    rows = decode_logs(logs).collect()
    assert sorted((r["block_number"], r["log_index"]) for r in rows) == [(n, i) for n in range(1000, 1050) for i in range(2)]
    assert all(r["block_timestamp"].timestamp() == r["block_number"] * 2 for r in rows)
    with pytest.raises(Exception, match="options missing"):
        spark.read.format("rpc_logs").option("url", url).load().count()


def test_ingest_goes_on_where_it_stopped(spark, url, tmp_path):
    folder = str(tmp_path / "raw")
    source = ingest.Source(url, 1, "n", TOKEN, TOPIC, chunk_blocks=50, wait=0)
    run = lambda **other: ingest.ingest(spark, source, folder, 1, 100, **({"segment_blocks": 20, "batch": 3} | other))
    with pytest.raises(ValueError, match="chain"):
        ingest.ingest(spark, ingest.Source(url, 5, "n", TOKEN, TOPIC, wait=0), folder, 1, 100)
    Chain.lost = {45}
    try:
        with pytest.raises(ingest.IncompleteError) as left:
            run()
        assert [f[:2] for f in left.value.failed] == [(41, 60)]
    finally:
        Chain.lost = set()
    half = segments.Manifest.load(segments.find_manifest(folder))
    assert [s.start_block for s in half.segments] == [1, 21, 61, 81] and not half.complete
    with pytest.raises(ValueError, match="not covered"):
        segments.extract_window(spark, folder, half, 30, 70, str(tmp_path / "cut"))
    with pytest.raises(ValueError, match="segmentation"):
        run(segment_blocks=10)
    Chain.limited.clear()
    done = run()
    assert (done.fetched, done.kept, done.row_count) == (1, 4, 200) and min(a for a, _ in Chain.limited) == 41
    whole = segments.Manifest.load(done.manifest)
    assert whole.complete and whole.start_time.startswith("1970-01-01T00:00:02") and run().fetched == 0
    report = segments.extract_window(spark, folder, whole, 15, 64, str(tmp_path / "cut"))
    assert (report.row_count, report.distinct_keys, report.last_event_at) == (100, 100, "1970-01-01 00:02:08")
    part = next((tmp_path / "raw" / "segment=21").glob("*.parquet"))
    part.unlink()
    with pytest.raises(ValueError, match="not sound"):
        segments.extract_window(spark, folder, whole, 15, 64, str(tmp_path / "again"))
    assert run().fetched == 1


def test_commands(spark, url, tmp_path, capsys):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "models")
    assert main(["fetch", "--url", url, "--token", TOKEN, "--topic", TOPIC, "--network", "n", "--chain-id", "1", "--start", "1", "--end", "60", "--out", raw]) == 0
    assert spark.read.parquet(f"{raw}/segment=*").count() == 120
    cut = str(tmp_path / "cut")
    assert main(["window", raw, "--start", "1", "--end", "60", "--out", cut]) == 0
    assert main(["transform", cut, "--out", out, "--disjoint"]) == 0
    raw = cut
    assert spark.read.parquet(f"{out}/stg_transfers").count() == 120
    assert main(["validate", raw, "--token", "0x" + "cd" * 20]) == 1
    shown = capsys.readouterr().out
    assert "mart_anomalies" in shown and shown.count(": 0 mismatches") == 9
