"""The comparison of two runs from files to reports."""

import json

import pytest

from glyphmill import cli


@pytest.fixture
def runs(tmp_path):
    (tmp_path / "samples").mkdir()
    for k in range(3):
        (tmp_path / "samples" / f"result_i{k}.json").write_text(json.dumps({"color": "SAND", "productCode": f"1800{k}", "size": "XL", "positionQuantity": "1/2"}))
    head = "filename,image_width,image_height,num_regions,"
    (tmp_path / "a.csv").write_text(head + "detection_ms,recognition_ms,total_ms,results\n" + "".join(f'i{k}.png,4,3,1,1.00,2.00,{10 + k}.00,"a ""q"" (0.9000), b (0.1000)"\n' for k in range(3)))
    (tmp_path / "b.csv").write_text(head + "total_ms,results\n" + "".join(f"i{k}.png,4,3,1,{20 + k}.00,\n" for k in range(3)))
    for side, texts in (("a", ["sand", "18000", "xl", "1/2"]), ("b", ["sond", "18000"])):
        (tmp_path / side).mkdir()
        for k in range(3):
            (tmp_path / side / f"i{k}_result.json").write_text(json.dumps({"source_image": f"i{k}.png", "text_regions": [{"text": t, "score": 0.9, "bbox": []} for t in texts], "total_regions": len(texts)}, indent=2))
    return tmp_path


def test_compare(spark, runs):
    options = cli.arguments(["compare", "--first-details", f"{runs}/a.csv", "--second-details", f"{runs}/b.csv", "--first-results", f"{runs}/a", "--second-results", f"{runs}/b", "--samples", f"{runs}/samples", "--output", f"{runs}/out", "--first-name", "a", "--second-name", "b"])
    out = cli.compare(spark, options)
    speed = {r.metric: r for r in out["speed_summary"].collect()}
    assert (speed["Average Time (ms)"].a, speed["Average Time (ms)"].b, speed["Average Time (ms)"].Speedup) == ("11.00", "21.00", "1.91x")
    assert speed["Avg Detection (ms)"].a == "1.00" and speed["Avg Detection (ms)"].b == "-"
    assert out["details_a"].where("match_type_color = 'exact'").count() == 3
    assert out["accuracy_summary"].where("Metric = '  Exact Match (%)'").first().Winner == "a"
    assert spark.read.csv(f"{runs}/out/details_b", header=True, escape='"').count() == 3
    assert cli.main(["compare", "--first-details", f"{runs}/a.csv", "--second-details", f"{runs}/b.csv", "--output", f"{runs}/two", "--skip-accuracy"]) == 0
