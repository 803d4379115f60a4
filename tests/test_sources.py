from weft.operators import reports
from weft.sources.clicks import read_click_columns, read_clicks_csv, read_field_unquoted, write_clicks_csv

CSV = """,datetime,duration,title,genres,release_date,movie_id,user_id
0,2017-01-01 01:15:09,0.0,"Angus, Thongs","Comedy, Drama",2008-07-25,m1,u1
1,2017-01-01 13:56:02,-1.0,Zulu,NOT AVAILABLE,NOT AVAILABLE,m2,u2
2,2017-01-01 13:56:02,9.0,Zulu,War,1964-01-22,m2,u2
"""


def test_csv(spark, tmp_path):
    path = str(tmp_path / "clicks.csv")
    (tmp_path / "clicks.csv").write_text(CSV)
    rows = read_clicks_csv(spark, path)
    assert rows.columns == ["datetime", "duration", "title", "genres", "release_date", "movie_id", "user_id"]
    assert [r.title for r in rows.collect()] == ["Angus, Thongs", "Zulu", "Zulu"]
    assert [r.value for r in read_field_unquoted(spark, path, 4).collect()] == ['"Angus', "Zulu", "Zulu"]
    assert reports.most_watched_title(rows).first()[0] == "Zulu"
    assert reports.average_duration(rows).first()[0] == 8 / 3
    assert reports.heaviest_user(rows).first()[0] == "u2"
    assert read_click_columns(spark, path, "duration", "user_id").columns == ["duration", "user_id"]


def test_only_first_lines_are_headers(spark, tmp_path):
    """A data line that equals the header stays, and each of several files loses its own first line."""
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("a,b\n1,x\na,b\n")
    assert sorted(r.value for r in read_field_unquoted(spark, str(tmp_path), 2).collect()) == ["b", "b", "x", "x"]


def test_csv_round_trip(spark, tmp_path):
    rows = [("2017-01-01 01:15:09.5", 0.5, 'a "quoted", title', "x, y", "NOT AVAILABLE", "m", "u"), (None, -1.0, None, "z", "2008-07-25", "m2", "u2")]
    schema = "datetime string, duration double, title string, genres string, release_date string, movie_id string, user_id string"
    write_clicks_csv(spark.createDataFrame(rows, schema), str(tmp_path / "log"))
    assert sorted(map(repr, (tuple(r) for r in read_clicks_csv(spark, str(tmp_path / "log")).collect()))) == sorted(map(repr, rows))
