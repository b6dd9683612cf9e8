"""Chart specs as JSON."""

import json

from pyspark.sql import functions as F

from orepulse.plans import dashboard as d


def spec(spark, chart):
    data = spark.sql(
        "SELECT array(named_struct('date', '2024-01-07', 'fuel_litres', 2.5D)) AS data, array('a', 'b') AS names, array(3, 4) AS counts, "
        "array(named_struct('kpi', 'idle_rate', 'value', 1.5D, 'unit', '%')) AS kpis"
    )
    return json.loads(data.select(F.to_json(chart)).first()[0])


def test_line_and_bar(spark):
    line = spec(spark, d.line_chart(F.lit("Fuel"), F.col("data"), "date", F.array(F.lit("fuel_litres"), F.lit("idle_hours"))))
    assert line["chart_type"] == "LineChart" and line["legend"] and line["data"][0]["fuel_litres"] == 2.5
    assert [(s["name"], s["color"]) for s in line["series"]] == [("Fuel Litres", d.PALETTE[0]), ("Idle Hours", d.PALETTE[1])]
    bar = spec(spark, d.bar_chart(F.lit("Top"), F.col("data"), "date", F.array(F.lit("fuel_litres"))))
    assert bar["layout"] == "vertical" and bar["x_axis"]["key"] == "date"


def test_scatter_pie_cards_heatmap(spark):
    assert spec(spark, d.scatter_chart(F.lit("S"), F.col("data"), "x", "y"))["color"] == d.PALETTE[0]
    pie = spec(spark, d.pie_chart(F.lit("P"), F.col("names"), F.col("counts")))
    assert pie["inner_radius"] == 60 and [x["_color"] for x in pie["data"]] == list(d.PALETTE[:2]) and pie["data"][1]["value"] == 4
    assert spec(spark, d.kpi_cards(F.lit("K"), F.col("kpis")))["cards"] == [{"label": "Idle Rate", "value": 1.5, "unit": "%"}]
    assert spec(spark, d.heatmap(F.lit("H"), F.col("data"), "r", "c", "v"))["color_scheme"] == "blue"
