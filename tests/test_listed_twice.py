import pytest

from opslens.operators import deliveries as D
from tests.helpers import frame, ts
from tests.test_deliveries import DDL

STAMPS = "2016-08-05 09:00:00,2016-08-05 10:00:00,2016-08-05 18:00:00"


@pytest.mark.parametrize("limits", [{}, {"heavy_rows": 0}, {"heavy_visits": 0, "slice_ids": 1}])
def test_each_row_of_a_visit_listed_twice_takes_its_own_stamp(spark, limits):
    def row(booking, cancelled):
        return {"visit_id": 1, "booking_id": booking, "visit_status": "cancelled", "ofd_happened_at": STAMPS,
                "cancellation_time": ts(cancelled)}

    got = D.assign_ofd(frame(spark, DDL, [
        row(7, "2016-08-05 12:00:00"), row(7, "2016-08-05 12:00:00"),
        row(8, "2016-08-05 09:30:00"), row(8, None), row(9, "2016-08-05 11:00:00"), row(9, "2016-08-05 08:00:00")]), **limits).collect()
    nine, ten = ts("2016-08-05 09:00:00"), ts("2016-08-05 10:00:00")
    assert sorted((r.booking_id, str(r.cancellation_time), str(r.ofd_time)) for r in got) == sorted([
        (7, "2016-08-05 12:00:00", str(nine)), (7, "2016-08-05 12:00:00", str(ten)), (8, "2016-08-05 09:30:00", str(nine)),
        (8, "None", "None"), (9, "2016-08-05 11:00:00", str(nine)), (9, "2016-08-05 08:00:00", "None")])
