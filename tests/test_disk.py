"""What queries leave below the shared folder."""

import os

import __spark_entry__ as entry
from modelshift.session import shared_folder


def test_compared_models_leave_no_dataset(spark, sf_dir):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = entry.queries()["round_trip_models"](spark, sf_dir).collect()
    assert len(rows) == 16 and all(r["equal"] and r["same_count"] for r in rows)
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("dataset-")]
