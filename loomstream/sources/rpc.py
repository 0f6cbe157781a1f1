"""Raw transfer logs read from a JSON-RPC node, a partition a segment of blocks."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from enum import Enum

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .logs import RAW_LOGS
from .segments import plan_segments

# What nodes answer when they ask for patience, and when they will not serve so large a range at all.
BUSY_STATUS = {429, 500, 502, 503, 504}
BUSY_CODES = {-32016, -32005}
RANGE_CODES = {-32020, -32614}
RANGE_WORDS = ("block range", "too many", "limit exceeded", "query returned more than", "too large", "limited to a", "response size")


class RpcError(Exception):
    """The node's final answer is an error; code is the node's, if it gave one."""

    def __init__(self, message: str, code: int | None = None) -> None:
        super().__init__(message)
        self.code = code


class RangeRefused(RpcError):
    """The node will not serve so many blocks or logs at once."""


class Verdict(Enum):
    RANGE = "ask for less"
    BUSY = "ask again later"
    FINAL = "do not ask again"


def verdict(status: int, code: int | None = None, message: str = "") -> Verdict:
    """What to make of an error: the code says most, then the message, then the status."""
    by_code = {**dict.fromkeys(RANGE_CODES, Verdict.RANGE), **dict.fromkeys(BUSY_CODES, Verdict.BUSY)}
    if code in by_code:
        return by_code[code]
    low = message.lower()
    if "rate limit" in low or "too many requests" in low:
        return Verdict.BUSY
    if any(words in low for words in RANGE_WORDS):
        return Verdict.RANGE
    return Verdict.BUSY if status in BUSY_STATUS else Verdict.FINAL


class Meter:
    """How wide the next question may be, from the density of logs in the answers so far.

    Answers count less with every further one, so the density follows the chain.  A refused width is not asked for
    again until PATIENCE answers later; nothing else is remembered of it.
    """

    AIM, FADE, PATIENCE = 5_000, 0.8, 25

    def __init__(self, most: int) -> None:
        self.most, self.blocks, self.logs = max(1, most), 0.0, 0.0
        self.refused, self.calm = None, 0

    def width(self) -> int:
        out = self.most
        if self.logs > 0:
            out = min(out, int(self.AIM * self.blocks / self.logs))
        if self.refused is not None:
            out = min(out, self.refused - 1)
        return max(1, out)

    def answered(self, blocks: int, logs: int) -> None:
        self.blocks, self.logs = self.blocks * self.FADE + blocks, self.logs * self.FADE + logs
        self.calm += 1
        if self.calm >= self.PATIENCE:
            self.refused, self.calm = None, 0

    def declined(self, blocks: int) -> None:
        self.refused, self.calm = min(blocks, self.refused or blocks), 0


class Node:
    def __init__(self, url: str, *, tries: int = 6, wait: float = 1.0, timeout: float = 60) -> None:
        self.url, self.tries, self.wait, self.timeout = url, tries, wait, timeout

    def _post(self, payload: bytes) -> tuple[int, object]:
        """(status, the answer's JSON, None if it is none)."""
        request = urllib.request.Request(self.url, payload, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310 - the caller's own node
                status, body = answer.status, answer.read()
        except urllib.error.HTTPError as e:
            status, body = e.code, e.read()
        try:
            return status, json.loads(body)
        except ValueError:
            return status, None

    def _ask(self, payload: bytes) -> tuple[Verdict | None, object, int | None]:
        """(None, result, None), or what to make of the error, the error in words, and its code."""
        try:
            status, answer = self._post(payload)
        except OSError as e:
            return Verdict.BUSY, f"{type(e).__name__}: {e}", None
        answer = answer if isinstance(answer, dict) else {}
        if error := answer.get("error"):
            code, message = error.get("code"), str(error.get("message", ""))
            return verdict(status, code, message), f"{code}: {message}", code
        if status < 400 and "result" in answer:
            return None, answer["result"], None
        return verdict(status), f"HTTP {status}: not an answer", None

    def call(self, method: str, params: list) -> object:
        """The result; a busy node or a broken connection is asked again, each wait up to three times the last one and
        half a minute at most; other errors are final."""
        payload = json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode()
        pause, said = self.wait, ""
        for left in reversed(range(self.tries)):
            what, said, code = self._ask(payload)
            if what is None:
                return said
            if what is not Verdict.BUSY:
                raise (RangeRefused if what is Verdict.RANGE else RpcError)(said, code)
            if left:
                pause = min(30 * self.wait, random.uniform(self.wait, 3 * pause))
                time.sleep(pause)
        raise RpcError(f"{method}: {self.tries} tries failed, the last with {said}")

    def chain_id(self) -> int:
        return int(self.call("eth_chainId", []), 16)

    def logs(self, address: str, topics: list, first: int, last: int) -> list[dict]:
        return self.call("eth_getLogs", [{"address": address, "topics": topics, "fromBlock": hex(first), "toBlock": hex(last)}])

    def block_time(self, block: str) -> str:
        found = self.call("eth_getBlockByNumber", [block, False])
        if not found:
            raise RpcError(f"block {block} is missing")
        return found["timestamp"]

    def chunks(self, address: str, topics: list, first: int, last: int, meter: Meter) -> Iterator[list[dict]]:
        """The logs of each block once, in order: ranges are cut to the meter's width, and a refused one in halves."""
        ranges = [(first, last)] if first <= last else []
        while ranges:
            a, b = ranges.pop()
            cut = min(b, a + meter.width() - 1)
            if cut < b:
                ranges.append((cut + 1, b))
            try:
                found = self.logs(address, topics, a, cut)
            except RangeRefused:
                if a == cut:
                    raise
                meter.declined(cut - a + 1)
                middle = (a + cut) // 2
                ranges += [(middle + 1, cut), (a, middle)]
                continue
            if any(not a <= int(log["blockNumber"], 16) <= cut for log in found):
                raise RpcError(f"logs of blocks outside of {a} to {cut}")
            meter.answered(cut - a + 1, len(found))
            yield found


class Blocks(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class RpcLogs(DataSource):
    """spark.read.format("rpc_logs") with the options url, address, topic, and start and end or segments ("first-last"
    pairs of blocks with commas between, read in this order); optional are segment_blocks (2,000: the blocks of a
    partition), chunk_blocks (500: asked for at most) and wait (1: seconds that waiting is counted in).  One row a log
    as the node gives it, each once, in order; a log without a time takes that of its block; a log of a block that was
    not asked for is an error.  A lost task reads its segment again."""

    @classmethod
    def name(cls) -> str:
        return "rpc_logs"

    def schema(self) -> str:
        return RAW_LOGS

    def reader(self, schema) -> DataSourceReader:
        return RpcLogsReader(dict(self.options))


class RpcLogsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        need = ("url", "address", "topic", *(() if "segments" in options else ("start", "end")))
        missing = [k for k in need if k not in options]
        if missing:
            raise ValueError(f"options missing: {', '.join(missing)}")
        self.options = options

    def partitions(self) -> list[Blocks]:
        o = self.options
        if "segments" in o:
            return [Blocks(*map(int, pair.split("-"))) for pair in o["segments"].split(",")]
        return [Blocks(a, b) for a, b in plan_segments(int(o["start"]), int(o["end"]), int(o.get("segment_blocks", 2000)))]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        o = self.options
        node = Node(o["url"], wait=float(o.get("wait", 1)))
        for logs in node.chunks(o["address"], [o["topic"]], partition.first, partition.last, Meter(int(o.get("chunk_blocks", 500)))):
            times: dict[str, str] = {}
            # Of logs with one key the first counts; a range's answer holds whole blocks, so repeats are within it.
            once = {(log["transactionHash"].lower(), int(log["logIndex"], 16)): log for log in reversed(logs)}
            for log in sorted(once.values(), key=lambda x: (int(x["blockNumber"], 16), int(x["logIndex"], 16))):
                at, when = log["blockNumber"], log.get("blockTimestamp")
                if when is None:
                    when = times[at] = times.get(at) or node.block_time(at)
                yield log["address"], at, log["logIndex"], log["transactionHash"], log["topics"], log["data"], when, bool(log.get("removed", False))
