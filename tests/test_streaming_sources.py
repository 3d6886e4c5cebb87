import json
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from folioflow.sources import paged
from folioflow.streaming import limits, subscribers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Source:
    """A paged endpoint of n records; fails says how often a start is refused, short whose pages lack rows."""

    def __init__(self):
        self.n, self.fails, self.short, self.asked = 0, Counter(), {}, Counter()
        source = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                asked = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
                start, count = asked["start"], asked["count"]
                source.asked[(start, count)] += 1
                if source.fails[start] > 0 and count > 1:
                    source.fails[start] -= 1
                    self.send_error(503)
                    return
                rows = [{"name": f"n{k}", "level": "I"} for k in range(start, min(start + count, source.n))][: source.short.get(start, count)]
                body = json.dumps({"recordsTotal": source.n, "data": rows}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/?start={{start}}&count={{count}}"


@pytest.fixture
def source():
    made = Source()
    yield made
    made.server.shutdown()


def read_new(spark, source, folder, **options):
    """Runs the query until it has read all there is, and gives all names that were written so far."""
    paged.register(spark)
    stream = spark.readStream.format("paged_records").options(url=source.url, pagesize=3, attempts=3, wait=0, delay=0, **options).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(int(r["name"][1:]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_a_restarted_stream_reads_each_record_once(spark, source, tmp_path):
    source.n = 7
    assert read_new(spark, source, tmp_path) == list(range(7))
    assert (0, 3) in source.asked and (6, 1) in source.asked, "one request for each page"
    source.n = 12
    source.fails[10] = 2
    assert read_new(spark, source, tmp_path) == list(range(12))
    assert source.asked[(0, 3)] == 1 and source.asked[(7, 3)] == 1, "what was read isn't asked for again"
    assert source.asked[(10, 2)] == 3, "a page that fails is asked for again"
    assert read_new(spark, source, tmp_path) == list(range(12))


def test_a_batch_that_broke_off_is_read_again_with_its_bounds(spark, source, tmp_path):
    source.n, source.short = 6, {3: 1}
    with pytest.raises(Exception, match="1 of 3 rows from 3 on"):
        read_new(spark, source, tmp_path)
    source.short, source.n = {3: 0}, 8
    with pytest.raises(Exception, match="no rows from 3 on"):
        read_new(spark, source, tmp_path)
    source.short = {}
    assert read_new(spark, source, tmp_path) == list(range(6)), "the batch keeps its bounds"
    assert read_new(spark, source, tmp_path) == list(range(8))
    assert source.asked[(6, 2)] == 1


def test_a_stream_from_a_record_on_and_an_empty_source(spark, source, tmp_path):
    source.n = 5
    assert read_new(spark, source, tmp_path / "a", **{"from": 4}) == [4]
    source.n = 3
    with pytest.raises(Exception, match="were read before"):
        read_new(spark, source, tmp_path / "a", **{"from": 4})
    source.n = 0
    paged.register(spark)
    reader = paged.PagedStream({"url": source.url, "delay": 0})
    assert reader.latestOffset() == {"records": 0} and reader.partitions({"records": 0}, {"records": 0}) == []


EVENTS = "event_id long, user_id long, ts timestamp"
BASE = 1_700_000_000_000_000


def limited_by_stream(spark, tmp_path, parts, seconds, most, delay="1 hour"):
    """Feeds parts of (event_id, user_id, micros) one after the other; gives verdicts by event and the query's state rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = f"{tmp_path}/in"
    for k, part in enumerate(parts):
        rows = spark.createDataFrame(part, "event_id long, user_id long, at long").select("event_id", "user_id", F.timestamp_micros("at").alias("ts"))
        rows.coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = limits.rate_limited_stream(stream, "user_id", seconds, most, delay).writeStream.format("memory").queryName(f"l{tmp_path.name.replace('-', '_')}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(240)
    rows = spark.table(f"l{tmp_path.name.replace('-', '_')}").collect()
    return {r["event_id"]: (r["user_id"], r["in_window"], r["limited"]) for r in rows}, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_stream_of_limits_equals_the_window(spark, tmp_path):
    rng = random.Random(5)
    seconds, most = 60, 3
    at = sorted(BASE + rng.randrange(0, 900) * 1_000_000 + rng.choice([0, 0, 1, 999_999]) for _ in range(400))
    rows = [(k, rng.choice([1, 1, 1, 2, 3]), t) for k, t in enumerate(at)]
    found, _ = limited_by_stream(spark, tmp_path, [rows[:150], rows[150:300], rows[300:]], seconds, most)
    table = spark.createDataFrame(rows, "event_id long, user_id long, at long").select("event_id", "user_id", F.timestamp_micros("at").alias("ts"))
    wanted = {r["event_id"]: (r["user_id"], min(r["in_window"], most + 1), r["limited"]) for r in subscribers.rate_limited(table, "user_id", seconds, most).collect()}
    assert found == wanted and any(w[2] for w in wanted.values()) and not all(w[2] for w in wanted.values())


def test_a_flood_and_past_windows_leave_little_state(spark, tmp_path):
    flood = [(k, 1, BASE + k) for k in range(3000)]
    others = [(10_000 + k, 100 + k, BASE + k) for k in range(50)]
    later = [(20_000 + k, 1, BASE + (3 + k) * 3_600_000_000) for k in range(3)]
    found, state = limited_by_stream(spark, tmp_path, [flood + others, *([x] for x in later)], 60, 5, "1 minute")
    assert sum(v[2] for v in found.values()) == 2995 and not found[20_000][2]
    assert max(state[:1]) <= 6 * (5 + 1 + 50) and state[-1] <= 12, "old keys are gone, a flood keeps a few times"
