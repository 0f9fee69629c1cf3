"""A replayed stream of edits ends in the state that the batch plan finds."""

from turnwise.streaming import session_state

SCHEMA = "session_id long, turn_index long, op string, a string, lo string, hi string"
EDITS = [
    (1, 0, "SET_CLOSED", "n1", None, None),
    (1, 2, "SET_OPEN", "n1", None, None),
    (1, 1, "SET_CLOSED", "n1", None, None),
    (1, 3, "ADD", "n1", "n1", "n2"),
    (2, 0, "ADD", "n1", "n1", "n2"),
    (2, 1, "DEL", "n1", "n1", "n2"),
    (2, 1, "DEL", "n1", "n1", "n2"),
    (2, 2, "NOOP", None, None, None),
    (3, 0, None, "n1", None, None),
]


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame(EDITS[i::3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    state = {}

    def upsert(rows, batch_id):
        for r in rows.collect():
            state[r.session_id, r.key] = (r["on"], r.turn_index)

    session_state.keep_state(stream, str(tmp_path / "checkpoint"), upsert).awaitTermination()
    batch = {(r.session_id, r.key): (r["on"], r.turn_index) for r in session_state.last_operations(spark.createDataFrame(EDITS, SCHEMA)).collect()}
    assert state == batch == {(1, "n:n1"): (True, 2), (1, "e:n1-n2"): (True, 3), (2, "e:n1-n2"): (False, 1)}
