"""Predictions whose outcome comes, comes twice, comes too late or never comes."""

import datetime as dt

from ledgerloom.streaming import events


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_every_prediction_goes_out_once(spark, tmp_path):
    """Four deliveries, the stream started anew for each."""
    made = "prediction_id long, predicted_at timestamp, predicted_value double"
    told = "prediction_id long, actual_at timestamp, actual_value double"
    deliveries = [
        ([(1, at(0), 10.0), (2, at(1), 20.0), (3, at(2), 30.0), (9, at(2), None)], [(1, at(3), 11.0), (1, at(3), 11.0), (None, at(3), 5.0)]),
        ([(4, at(20), 40.0)], [(2, at(24), 22.0), (8, at(22), 80.0)]),
        ([(5, at(60), 50.0)], [(3, at(59), 33.0), (2, at(58), 99.0)]),  # 3 is answered past its horizon, 2 again past it
        ([(6, at(200), 60.0), (7, None, 70.0)], [(6, at(201), 66.0), (4, at(30), 44.0)]),  # 4 is answered behind the watermark
    ]
    for name, schema in (("made", made), ("told", told)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(schema).parquet(str(tmp_path / name)) for name, schema in (("made", made), ("told", told))]
    for predictions, actuals in deliveries:
        spark.createDataFrame(predictions, made).coalesce(1).write.mode("append").parquet(str(tmp_path / "made"))
        spark.createDataFrame(actuals, told).coalesce(1).write.mode("append").parquet(str(tmp_path / "told"))
        events.run_to_files(events.predictions_answered_or_lapsed(*streams), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = sorted((r.prediction_id, r.actual_value) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.prediction_id != 7)
    assert rows == [(1, 11.0), (2, 22.0), (3, None), (4, None), (5, None), (6, 66.0), (9, None)]
