import datetime as dt

import pyarrow as pa
from conftest import SF, day
from pyspark.sql import functions as F

from racecard import session
from racecard.functions import clean
from racecard.plans import derived_pages, queries_tables
from racecard.plans import runs as plans_runs
from racecard.plans.runs import runs
from racecard.schema import PAGES, RESULTS
from racecard.sources import odds, page_sql, pages, tables
from racecard.streaming import streams

HEADERS = ["着 順", "枠番", "馬番", "馬名", "性齢", "斤量", "騎手", "タイム", "着差", "上り", "単勝", "人気", "馬体重", "調教師"]
NOW = dt.datetime(2024, 1, 1)


def page(spark, kind, key, html, charset="euc-jp"):
    return spark.createDataFrame([(kind, key, NOW, bytearray(html.encode(charset)))], PAGES)


def cells(*texts, tag="td"):
    return "<tr>" + "".join(f"<{tag}>{t}</{tag}>" for t in texts) + "</tr>"


def result_html(cls="race_table_01", headers=HEADERS):
    full = ["1", "3", "05", '<a href="/horse/2019105219/" title="a > b"> ウマ A </a>', "牡4", "57", '<a href="/jockey/result/recent/01096/">騎手</a>',
            "1:34.5", "", "33.8", "3.5", "1", "444(-4)", '[東]<a href="/trainer/01167/">師 &amp; 匠</a>']
    plain = ["中", "3", "06", " ウマ \n B ", "牝3", "▲55", "誰か", "", "", "", "---", "", "計不", "師"]
    body = cells(*full) + cells("short", "row") + cells(*plain)
    return f"<p>着順</p><table><tr><td>first</td></tr></table><table class='x {cls}' summary=\"a>b\">{cells(*headers, tag='th')}{body}</table>"


def test_results_page(spark):
    for cls in ("race_table_01", "race_table_old"):
        rows = pages.extract_results(page(spark, "result", "202301010101", result_html(cls))).collect()
        assert len(rows) == 2
        a, b = sorted(rows, key=lambda r: r.horse_no)
        assert (a.race_id, a.finish, a.horse_name, a.horse_id, a.jockey, a.jockey_id) == ("202301010101", "1", "ウマ A", "2019105219", "騎手", "01096")
        assert (a.trainer, a.trainer_id, a.up_3f, a.odds, a.popularity, a.body_weight) == ("師 & 匠", "01167", "33.8", "3.5", "1", "444(-4)")
        assert (b.horse_name, b.horse_id, b.jockey, b.jockey_id, b.finish, b.carried) == ("ウマ B", None, "誰か", None, "中", "▲55")


def test_page_without_a_needed_header_yields_nothing(spark):
    html = result_html(headers=HEADERS[:-1] + ["馬主"])
    assert pages.extract_results(page(spark, "result", "r", html)).count() == 0
    assert pages.extract_results(page(spark, "result", "r", "<p>none</p>")).count() == 0


def test_newer_table_class_wins(spark):
    html = result_html("race_table_old").replace("ウマ A", "古い") + result_html()
    names = {r.horse_name for r in pages.extract_results(page(spark, "result", "r", html)).collect()}
    assert "古い" not in names


def test_entries_page(spark):
    def row(n, tds):
        return f'<tr class="HorseList odd">{"".join(f"<td>{t}</td>" for t in tds[:n])}</tr>'

    tds = ["1", "2", "", '<a href="https://x/horse/2019105219">ウマ</a>', "牡4", "57", '<a href="/jockey/01096/">J</a>',
           '<a href="/trainer/01167/">T</a>', "", "**", "3"]
    html = f"<table class='Shutuba_Table shutuba_table RaceTable'>{cells('a', tag='th')}{row(7, tds)}{row(8, tds)}{row(11, tds)}<tr><td>x</td></tr></table>"
    rows = pages.extract_entries(page(spark, "entry", "202301010101", html, "utf-8")).collect()
    assert len(rows) == 2  # seven cells are too few, eight are enough
    for r in rows:
        assert (r.horse_no, r.horse_name, r.horse_id, r.jockey_id, r.trainer_id) == ("2", "ウマ", "2019105219", "01096", "01167")
        assert (r.body_weight, r.odds) == ("470(0)", "999.0")
    assert sorted(r.popularity for r in rows) == ["3", "99"]
    unmarked = html.replace("HorseList", "Other").replace("shutuba_table", "t")
    assert pages.extract_entries(page(spark, "entry", "r", unmarked, "utf-8")).count() == 2


def test_history_page(spark):
    def row(date, race, name, finish, up):
        tds = [date, "", "", "", f'<a href="/race/{race}/">{name}</a>'] + [""] * 23
        tds[11], tds[27] = finish, up
        return cells(*tds)

    heads = [f"h{i}" for i in range(28)]
    html = f"<table class='db_h_race_results nk'>{cells(*heads, tag='th')}{row('2023/05/28', '202305020411', 'G1', '1', '33.8')}{row('2023/01/01', '2023J0a01', '海外', '2', '')}</table>"
    rows = pages.extract_history(page(spark, "history", "h1", html)).orderBy("hist_pos").collect()
    assert [(r.hist_pos, r.race_id, r.finish, r.up_3f, r.race_date) for r in rows] == [
        (0, "202305020411", "1", "33.8", dt.date(2023, 5, 28)), (1, None, "2", "", dt.date(2023, 1, 1))]
    narrow = f"<table><tr><th>x</th></tr></table><table>{cells('日付', '着差', '着 順', 'R', 'レース', '上り', tag='th')}{cells('2023/05/28', '0.1', '4', '1', '杯', '35.1')}</table>"
    r = pages.extract_history(page(spark, "history", "h1", narrow)).first()
    assert (r.finish, r.up_3f, r.race_name) == ("4", "35.1", "杯")


def test_career_page(spark):
    other = f"<table>{cells('2023', *['9.9%'] * 12)}</table>"
    totals = f"<table>{cells(*['h'] * 13, tag='th')}{cells('累計', *['1'] * 8, '19.5％', '', '50.1%', '')}</table>"
    r = pages.extract_entity_rates(page(spark, "jockey", "01096", other + totals)).first()
    assert (r.entity_type, r.id, r.win_rate, r.place_rate, r.extract_status) == ("jockey", "01096", 0.195, 0.501, "ok")
    r = pages.extract_entity_rates(page(spark, "trainer", "1", other)).first()
    assert (r.win_rate, r.place_rate, r.extract_status) == (0.0, 0.0, "no_totals")


def test_comments_scripts_and_nesting(spark):
    html = "<!-- <table class='race_table_01'> --><script>'<table>'</script><table class=o><tr><td>a<table class=i><tr><td>b</td></tr></table>c</td><td>d</td></tr></table>"
    found = pages._parse(html)
    assert [(t["cls"], [[c["text"] for c in r["cells"]] for r in t["rows"]]) for t in found] == [("o", [["abc", "d"]]), ("i", [["b"]])]


def test_plain_pages_take_the_short_way():
    """Tables of plain cells are listed by one pattern a cell, all others tag by tag, with the same outcome."""
    row = "<tr class='r x'><th b=\"c\">h</th> t <td>\n a <a href='/z' id=q>l</a> r\n</td><td></td></tr><td>late</td>"
    plain = f"<!DOCTYPE html><p>x</p><a href='y'>z</a><table class=\"c\">{row}<tr>{row}</table> a < b"
    assert pages._scan_plain(plain[:-6]) == pages._scan_any(plain[:-6]) and len(pages._scan_any(plain)[0][1]) == 3
    for other in ("<table><tr><td><table><tr><td>1</td></tr></table></td></tr></table>", "<table><tr><td>1</table>",
                  "<table><tr><td>a<br>b</td></tr></table>", "<TABLE><tr><td>1</td></tr></TABLE>",
                  "<table><tr><td title='<td>'>1</td></tr></table>", "<table><td>1</td></table>",
                  "<!-- <table><tr><td>1</td></tr></table> -->", "<table><tr></a><td>1</td></tr></table>",
                  "<script><table></script><table><tr><td>1</td></tr></table>"):
        assert pages._scan_plain(other) is None, other
    assert pages._scan("<table><tr><td>a &amp; b</td></tr></table>") == [("", [("", [[False, "a & b", None, None]])])]


def test_texts_of_tables_are_stripped(spark):
    html = "<table><tr><td>\u3000\n a b <a href='/x'>\u00a0l </a></td></tr></table>"
    cell = pages._with_tables(page(spark, "entry", "1", html, "utf-8"), "entry").first().tables[0].rows[0].cells[0]
    assert (cell.text, cell.link) == ("a b \u00a0l", "l")


def test_page_tasks_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(plans_runs, "LINES_PER_PAGE_TASK", 300)
    parts = plans_runs.page_parts(spark, SF)
    assert parts == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300) > 4
    made = derived_pages.entry_pages(runs(spark, SF), parts)
    assert made.rdd.getNumPartitions() == parts
    one, many = (sorted(map(str, m.collect())) for m in (derived_pages.entry_pages(runs(spark, SF)), made))
    assert one == many


def test_rows_of_a_page_reach_sql_as_plain_values():
    raw = b"<table class=c><tr class=r><td> a<a href='/x'>b</a></td></tr></table>"
    assert list(page_sql.PageRows.func().eval("entry", raw)) == [(0, "c", 0, "r", [[False, " ab", "/x", "b"]])]


def test_odds_feed(spark):
    body = '{"status":"%s","data":{"odds":{"1":{"1":["3.5","0","1","05"],"2":["---","0","2","06"],"3":["4.0","0","3"],"4":["9.9","0","4","A1"]},"2":{}}}}'
    feed = spark.createDataFrame([("r", NOW, body % "middle"), ("q", NOW, body % "none"), ("p", NOW, "broken")], "race_id string, as_of timestamp, body string")
    got = {(r.race_id, r.horse_no): (r.odds, r.popularity) for r in odds.parse_live_odds(feed).collect()}
    assert got == {("r", "5"): ("3.5", "1"), ("r", "A1"): ("9.9", "4")}


def test_latest_odds_ignores_arrival_order_and_overlay(spark):
    schema = "race_id string, horse_no string, odds string, popularity string, as_of timestamp, pos int"
    rows = [("r", "5", "2.0", "1", NOW, 0), ("r", "5", "9.0", "8", NOW - dt.timedelta(hours=1), 0)]
    latest = odds.latest_odds(spark.createDataFrame(rows, schema))
    entries = spark.createDataFrame([("r", "05", "7.0", "3"), ("r", "6", "999.0", "99"), ("q", "5", "1.1", "1")], "race_id string, horse_no string, odds string, popularity string")
    got = sorted(map(tuple, odds.overlay_odds(entries, latest).collect()))
    assert got == [("q", "5", "1.1", "1"), ("r", "05", "2.0", "1"), ("r", "6", "999.0", "99")]


def test_csv_keeps_text(spark, tmp_path):
    path = tmp_path / "results.csv"
    path.write_text("﻿race_id,着順,馬番,馬名,騎手ID,単勝オッズ\n202301010101,01,05,ウマ,01096,3.5\n202301010101,,06,,,---\n", encoding="utf-8")
    a, b = tables.load_results(spark, str(path)).orderBy("horse_no").collect()
    assert (a.race_id, a.finish, a.horse_no, a.jockey_id, a.odds, a.trainer_id) == ("202301010101", "01", "05", "01096", "3.5", None)
    assert b.finish is None and b.jockey_id is None


def test_append_twice_stores_once(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = runs(spark, SF)
    tables.append_results(batch, path)
    tables.append_results(batch, path)
    stored = tables.stored_results(spark, path)
    assert stored.count() == batch.count() == stored.select("race_id", "horse_no").distinct().count()
    assert stored.where(F.substring("race_id", 1, 4) != F.col("season")).count() == 0


def test_rate_map_and_store(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"01096": {"jockey_win_rate": 0.2, "jockey_place_rate": 0.5}, "00001": {}}')
    rates = tables.load_rate_map(spark, str(tmp_path / "j.json"), "jockey")
    store = str(tmp_path / "store")
    tables.upsert_entity_rates(rates, store)
    tables.upsert_entity_rates(rates.withColumn("win_rate", F.lit(9.0)), store)
    held = {r.id: (r.win_rate, r.place_rate) for r in tables.load_entity_rates(spark, store).collect()}
    assert held == {"01096": (0.2, 0.5), "00001": (0.0, 0.0)}


def test_grid(spark):
    meetings = spark.createDataFrame([("2023", "05", "01")], "year string, venue string, meeting string")
    ids = sorted(r[0] for r in tables.race_id_grid(meetings).collect())
    assert ids == ["202305010101", "202305010102", "202305010103", "202305010201", "202305010202", "202305010203"]


def test_ingest_stream_splits_and_replays(spark, tmp_path):
    rows = [("202301010101", "1", str(n), day(0)) for n in range(6)]
    df = spark.createDataFrame(rows, "race_id string, finish string, horse_no string, race_date date")
    landing, path = str(tmp_path / "in"), str(tmp_path / "out")
    tables.conform(df, RESULTS).repartition(3, "horse_no").write.parquet(landing)
    tables.conform(df, RESULTS).write.mode("append").parquet(landing)  # everything again
    for replay in "ab":
        stream = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(landing)
        streams.ingest_stream(stream, path, str(tmp_path / f"c{replay}"), once=True).awaitTermination()
    assert sorted(r.horse_no for r in tables.stored_results(spark, path).collect()) == list("012345")


def test_links(spark):
    df = spark.createDataFrame([(1, '<a href="/horse/2019105219/">x</a><a href="/race/202305020411/">')], "page_id long, html string")
    got = [(r.link_no, r.horse_id, r.race_id) for r in pages.page_links(df).collect()]
    assert got == [(0, "2019105219", ""), (1, "", "202305020411")]


def test_percent_column(one):
    assert one("勝率 19.5%", clean.percent) == 0.195


def test_loose_page_files(spark, tmp_path):
    entity = "<table><tr><td>累計</td>" + "<td>1</td>" * 8 + "<td>19.5％</td><td></td><td>50.1</td></tr></table>"
    made = {"history/jockey/01096.html": entity.encode("euc-jp"), "kind=trainer/key=01167/part-0.txt": entity.encode("euc-jp"),
            "result/202301010101": result_html().encode("euc-jp"), "result/x.y.html": b"x", "entry/1.html": b"", "other/1.html": b"<p>", "notes.txt": b"x"}
    for name, raw in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    found = pages.load_page_files(spark, str(tmp_path))
    assert found.schema.simpleString() == PAGES.simpleString()
    rows = {(r.kind, r.key): bytes(r.raw) for r in found.collect()}
    assert rows == {("jockey", "01096"): made["history/jockey/01096.html"], ("result", "x.y"): b"x",
                    ("trainer", "01167"): made["kind=trainer/key=01167/part-0.txt"],
                    ("result", "202301010101"): made["result/202301010101"]}
    assert {(r.id, r.win_rate) for r in pages.extract_entity_rates(found).collect()} == {("01096", 0.195), ("01167", 0.195)}
    assert pages.extract_results(found).count() == 2


def test_stream_of_page_files(spark, tmp_path):
    def take():
        followed = pages.load_page_files(spark, str(tmp_path / "in"), stream=True)
        (followed.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
        return sorted(r.key for r in pages.load_pages(spark, str(tmp_path / "out")).collect())

    (tmp_path / "in" / "result").mkdir(parents=True)
    (tmp_path / "in" / "result" / "1.html").write_bytes(b"a")
    assert take() == ["1"]
    (tmp_path / "in" / "result" / "2.html").write_bytes(b"b")
    assert take() == ["1", "2"]


def test_pages_in_sql(spark):
    stored = page(spark, "result", "202301010101", result_html()).union(page(spark, "result", "r", "<p>none</p>"))
    stored = stored.union(spark.createDataFrame([("result", "n", NOW, None), ("unknown", "u", NOW, bytearray(b"<table><tr><td>1"))], PAGES))
    page_sql.register_pages(spark, stored, "told")
    rows = spark.sql("SELECT t.key, r.* FROM told t, LATERAL page_rows(t.kind, t.raw) r ORDER BY table_no, row_no").collect()
    assert [(r.key, r.table_no, r.row_no, len(r.cells)) for r in rows] == [
        ("202301010101", 0, 0, 1), ("202301010101", 1, 0, 14), ("202301010101", 1, 1, 14), ("202301010101", 1, 2, 2),
        ("202301010101", 1, 3, 14)]
    horse = rows[2].cells[3]
    assert (horse.th, horse.href, horse.link.strip()) == (False, "/horse/2019105219/", "ウマ A") and rows[1].cells[0].th
    assert spark.table("told_results").collect() == pages.extract_results(stored).collect()
    assert spark.table("told_rates").count() == 0 == spark.table("told_history").count()


def test_tables_leave_in_small_batches():
    """Whatever the number of pages in a batch, tables of few pages are held at a time; none is lost."""
    html = ("<table class=o><tr><th>h</th></tr>" + "<tr class=r><td><a href='/horse/1'>a&amp;b</a> c</td><td></td></tr>" * 400 + "</table>").encode()
    raws = [html, None, b""] * 200
    batch = pa.RecordBatch.from_pydict({
        "kind": ["entry"] * len(raws), "key": [str(i) for i in range(len(raws))],
        "fetched_at": pa.array([None] * len(raws), pa.timestamp("us")), "raw": pa.array(raws, pa.binary())})
    parts = list(pages._list_tables(iter([batch])))
    assert len(parts) > 5
    found = pa.Table.from_batches(parts).to_pylist()
    assert [r["key"] for r in found] == [str(i) for i in range(len(raws))]
    assert [r["tables"] for r in found] == [pages.page_tables(raw, "utf-8") for raw in raws]


def test_batches_of_pages_are_bounded_in_any_session(spark):
    name, most = session.ARROW_BYTES
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        pages.extract_entries(page(spark, "entry", "1", ""))
        assert spark.conf.get(name) in (most, str(8 << 20))
        spark.conf.set(name, "1m")
        pages.extract_entries(page(spark, "entry", "1", ""))
        assert spark.conf.get(name) in ("1m", str(1 << 20))
    finally:
        spark.conf.set(name, before)


def test_page_files_computes_the_runs_once(spark, monkeypatch):
    monkeypatch.setattr(queries_tables, "runs", None)  # lazy runs would be computed per kind of page
    assert queries_tables.page_files(spark, SF).count() == 60
