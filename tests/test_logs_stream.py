import datetime as dt

import pytest

from loomstream.schema import RAW_TRANSFERS
from loomstream.sources.logs import RAW_LOGS, decode_logs, transfers
from loomstream.streaming.daily import daily_activity

TOKEN = "0x" + "Ab" * 20


def wide(n):
    return "0x" + f"{n:064x}"


def log(**other):
    row = {"address": TOKEN, "blockNumber": "0x10", "logIndex": "0x2", "transactionHash": "0x" + "0F" * 32, "topics": [wide(9), wide(1), wide(2)], "data": wide(2500000), "blockTimestamp": "0x6553f100", "removed": False} | other
    return tuple(row.values())


def test_logs_decode_to_transfers(spark):
    logs = spark.createDataFrame([log(), log(logIndex="0x3", topics=[wide(9), wide(2), wide(2)], data=wide(0), removed=None)], RAW_LOGS)
    out = transfers(decode_logs(logs), chain_id=5, network="n", source="s", token=TOKEN)
    assert out.columns == RAW_TRANSFERS.fieldNames()
    a, b = out.orderBy("log_index").collect()
    assert (a.block_number, a.log_index, a.raw_amount, a.amount, a.is_self_transfer, a.token_address) == (16, 2, 2500000, 2.5, False, TOKEN.lower())
    assert a.event_id == "0x" + "0f" * 32 + "-2" and a.from_address == "0x" + f"{1:040x}" and a.to_address == "0x" + f"{2:040x}"
    assert b.is_self_transfer and b.amount == 0.0
    assert transfers(decode_logs(logs.limit(0)), chain_id=5, network="n", source="s").count() == 0


@pytest.mark.parametrize("bad", [{"topics": [wide(9), wide(1)]}, {"topics": None}, {"removed": True}, {"blockTimestamp": None}, {"address": "0x" + "cd" * 20}, {"data": wide(1 << 63)}])
def test_unsound_logs_are_refused(spark, bad):
    out = transfers(decode_logs(spark.createDataFrame([log(**bad)], RAW_LOGS)), chain_id=5, network="n", source="s", token=TOKEN)
    with pytest.raises(Exception, match="topics|removed|timestamp|token|63 bits"):
        out.collect()


def test_stream_of_days(spark, tmp_path):
    def event(key, at, a, b, amount):
        when = dt.datetime.fromisoformat(at)
        return (f"{key}-0", 1, when, key, 0, TOKEN, a, b, int(amount * 10**6), amount, a == b, 5, "n", "s", when)

    batches = [
        [event("k1", "2026-06-01 10:00", "a", "b", 1.0), event("k1", "2026-06-01 10:00", "a", "b", 1.0), event("k2", "2026-06-01 23:59", "b", "a", 2.0), event("k3", "2026-06-01 12:00", "a", "a", 9.0)],
        [event("k2", "2026-06-01 23:59", "b", "a", 2.0), event("k4", "2026-06-05 00:00", "a", "b", 4.0)],
        [event("k5", "2026-06-01 11:00", "a", "b", 8.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, RAW_TRANSFERS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(RAW_TRANSFERS).parquet(str(tmp_path / "in"))
        query = daily_activity(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        assert query.exception() is None, i
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("wallet_address").collect()
    day = dt.date(2026, 6, 1)
    assert [tuple(r) for r in rows] == [("a", day, 2, 1.0, 2.0), ("b", day, 2, 2.0, 1.0)]
