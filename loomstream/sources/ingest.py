"""Ingest of a block range in checkpointed segments: an interrupted run goes on where it stopped."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import decode_logs, transfers
from .rpc import Node, RpcLogs
from .segments import Manifest, Segment, plan_segments, stored_rows, verify_manifest


class IncompleteError(RuntimeError):
    """Some segments could not be read; all others are stored and noted in the manifest."""

    def __init__(self, failed: list[tuple[int, int, str]]) -> None:
        super().__init__("; ".join(f"blocks {a}-{b}: {why}" for a, b, why in failed[:5]))
        self.failed = failed


@dataclass(frozen=True)
class Source:
    """What is read: the logs of a token and topic from a node of a chain."""

    url: str
    chain_id: int
    network: str
    token: str
    topic: str
    decimals: int = 6
    chunk_blocks: int = 500
    wait: float = 1.0


@dataclass
class Ingested:
    manifest: str
    row_count: int
    segments: int
    fetched: int
    kept: int


def _folder(segment: tuple[int, int]) -> str:
    return f"segment={segment[0]}"


def _rows(spark: SparkSession, source: Source, segments: list[tuple[int, int]], blocks: int, start: int) -> DataFrame:
    """Canonical transfers of the segments, a partition each, with the segment's first block."""
    spark.dataSource.register(RpcLogs)
    options = {"url": source.url, "address": source.token, "topic": source.topic, "chunk_blocks": source.chunk_blocks, "wait": source.wait, "segments": ",".join(f"{a}-{b}" for a, b in segments)}
    rows = transfers(decode_logs(spark.read.format("rpc_logs").options(**options).load()), chain_id=source.chain_id, network=source.network, source="rpc", token=source.token, decimals=source.decimals)
    first = F.lit(start) + F.floor((F.col("block_number") - start) / blocks) * blocks
    return rows.withColumn("segment", first.cast("long")).sortWithinPartitions("segment", "block_number", "log_index")


def ingest(spark: SparkSession, source: Source, folder: str, start: int, end: int, *, segment_blocks: int = 2000, batch: int = 64, progress: Callable[[str], None] = lambda _: None) -> Ingested:
    """Store the transfers of blocks start to end below folder, in folders by segment, and a manifest of them.

    Segments that the manifest has and that are stored as it says are kept.  The others are read newest first, `batch`
    of them in a Spark job with a task each, so that what is there at any time is the latest history; a job's output
    is moved into place as a whole and then noted.  A batch that fails is read again in halves, down to the segments
    that cannot be read: they are reported when all others are stored.  The node must be of the expected chain, and a
    manifest of another segmentation, token or chain is refused.  A segment without logs has no file.
    """
    if start > end:
        raise ValueError("the range is empty")
    planned = plan_segments(start, end, segment_blocks)
    node = Node(source.url, wait=source.wait)
    if (chain := node.chain_id()) != source.chain_id:
        raise ValueError(f"the node is of chain {chain}, not {source.chain_id}")
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"manifest-{start}-{end}.json"
    fresh = Manifest(start, end, segment_blocks, source.token.lower(), source.chain_id, source.network, "rpc")
    manifest = Manifest.load(path) if path.exists() else fresh
    identity = lambda m: (m.start_block, m.end_block, m.segment_blocks, m.token_address, m.chain_id)
    if identity(manifest) != identity(fresh):
        raise ValueError(f"{path.name} is of another segmentation, token or chain; go on with the same or take another folder")
    found = stored_rows(spark, folder, [s.file for s in manifest.segments if s.file])
    sound = {(s.start_block, s.end_block): s for s in manifest.segments if (s.file is None and not s.row_count) or (s.file and found[s.file] == s.row_count)}
    sound = {k: s for k, s in sound.items() if k in set(planned)}
    kept = len(sound)
    pending = [s for s in reversed(planned) if s not in sound]
    work = [pending[i : i + batch] for i in range(0, len(pending), batch)][::-1]
    failed = []

    def note() -> None:
        manifest.segments = [sound[k] for k in sorted(sound)]
        manifest.save(path)

    note()
    while work:
        now = work.pop()
        try:
            _rows(spark, source, now, segment_blocks, start).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("segment").parquet(folder)
        except Exception as e:  # noqa: BLE001 - kept apart by halves, and reported
            if len(now) > 1:
                work += [now[len(now) // 2 :], now[: len(now) // 2]]
            else:
                failed.append((*now[0], str(e).strip().splitlines()[0][:300]))
            continue
        rows = stored_rows(spark, folder, [_folder(s) for s in now])
        at = dt.datetime.now(dt.UTC).isoformat()
        for s in now:
            n = rows[_folder(s)] or 0
            sound[s] = Segment(*s, n, _folder(s) if n else None, at)
        note()
        progress(f"{len(sound)} of {len(planned)} segments, {sum(s.row_count for s in sound.values())} rows")
    if failed:
        raise IncompleteError(sorted(failed))
    problems = verify_manifest(spark, folder, manifest)
    if problems:
        raise RuntimeError(f"stored segments are not sound: {'; '.join(problems[:5])}")
    iso = lambda block: dt.datetime.fromtimestamp(int(node.block_time(hex(block)), 16), dt.UTC).isoformat()
    manifest.start_time, manifest.end_time = iso(start), iso(end)
    manifest.row_count, manifest.complete = sum(s.row_count for s in manifest.segments), True
    manifest.save(path)
    return Ingested(str(path), manifest.row_count, len(planned), len(pending), kept)
