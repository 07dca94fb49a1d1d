import numpy as np

from mathquarry.functions import raster
from mathquarry.operators.pages import page_metrics
from mathquarry.plans.status import visual_gate


def page(height=20, width=30, dots=()):
    picture = np.full((height, width, 3), 255, dtype=np.uint8)
    for y, x, color in dots:
        picture[y, x] = color
    return raster.write_ppm(picture)


def test_metrics():
    same = raster.metrics(page(), page())
    assert (same["changed_pixels"], same["rms_diff"], same["diff_box"]) == (0, 0.0, None)
    found = raster.metrics(page(), page(dots=[(3, 4, 0), (5, 9, 0), (1, 1, 240)]))  # the last is below the threshold
    assert found["changed_pixels"] == 2 and found["changed_ratio"] == 2 / 600 and found["diff_box"] == {"left": 4, "top": 3, "right": 10, "bottom": 6}
    assert np.isclose(found["mean_abs_diff"], (255 * 2 + 15) / 600) and np.isclose(found["rms_diff"], np.sqrt((2 * 255**2 + 15**2) / 600))
    grown = raster.metrics(page(20, 30), page(25, 28, dots=[(24, 0, 0)]))
    assert (grown["width"], grown["height"], grown["changed_pixels"]) == (30, 25, 1)


def test_marks_and_round_trip():
    marked = raster.read_ppm(raster.marked(page(), page(dots=[(3, 4, 0)])))
    assert marked[3, 4].tolist() == [90, 0, 0] and marked[0, 0].tolist() == [255, 255, 255]
    assert raster.read_ppm(page(3, 2)).shape == (3, 2, 3)


def test_pages_of_documents(spark):
    left = [("a", 1, bytearray(page())), ("a", 2, bytearray(page())), ("b", 1, bytearray(page())), ("c", 1, bytearray(b"P6 x"))]
    right = [("a", 1, bytearray(page(dots=[(k // 30, k % 30, 0) for k in range(60)]))), ("b", 1, bytearray(page(dots=[(0, 0, 0)]))), ("c", 1, bytearray(page()))]
    schema = "doc_id string, page int, picture binary"
    rows = page_metrics(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), pictures=True)
    got = {(r.doc_id, r.page): r for r in rows.collect()}
    assert got["a", 1].changed_ratio == 0.1 and got["a", 2].changed_ratio is None and got["b", 1].marked and got["c", 1].error
    gate = {r.doc_id: r.status for r in visual_gate(rows).collect()}
    assert gate == {"a": "review-gated", "b": "passed", "c": "review-gated"}
