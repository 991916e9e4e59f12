"""Wide CSV loader on tiny trees (FIXTURES F1)."""

import os
import tempfile

from fleetrisk.sources.csv_telemetry import detect_inverter_count, load_all_plants

H1 = ("timestampDate,mac,sensors[0].ambient_temp,meters[0].freq,meters[0].meter_active_power,"
      "inverters[0].power,inverters[0].alarm_code,inverters[1].power,inverters[1].alarm_code,"
      "smu[0].string1,smu[0].string2,smu[0].id\n")
R1 = ["2024-03-01 10:00:00,AA,30,50.1,5,100,0,200,0,1,0,7\n",
      "2024-03-01 10:05:00,AA,31,49.9,6,inf,1,nan,0,2,2,7\n",
      "garbage,AA,1,1,1,1,1,1,1,1,1,1\n",
      "2024-03-01 11:00:00,AA,32,50.0,7,1d,0,300,0,,0,7\n"]
H2 = "timestamp,inverters[0].power,inverters[0].kwh_today\n"
R2 = ["1709287200000,10,1\n", "1709287500000,20,2\n"]


def _tree():
    root = tempfile.mkdtemp(prefix="fleetrisk-csv-")
    for d, name, h, rows in [("Plant 1", "a.csv", H1, R1), ("Plant 2", "b.csv", H2, R2), ("Plant 2", "empty.csv", "", [])]:
        os.makedirs(os.path.join(root, d), exist_ok=True)
        with open(os.path.join(root, d, name), "w") as fh:
            fh.write(h + "".join(rows))
    return root


def test_detect_inverter_count():
    assert detect_inverter_count(["inverters[0].a", "inverters[3].b", "inverters[x].c", "mac"]) == 4
    assert detect_inverter_count(["mac"]) == 0


def test_load_raw_and_hourly(spark):
    root = _tree()
    raw = load_all_plants(spark, root, hourly=False)
    rows = raw.collect()
    ids = sorted({r.inverter_id for r in rows})
    assert ids == ["Plant_1_AA_INV0", "Plant_1_AA_INV1", "Plant_2_b_INV0"]
    assert len(rows) == 3 * 2 + 2  # bad timestamp dropped; 2 inverters x 3 rows + 2 rows
    inv0 = sorted((r for r in rows if r.inverter_id == "Plant_1_AA_INV0"), key=lambda r: r.datetime)
    assert inv0[1].inv_power == float("inf") and inv0[2].inv_power is None  # 'inf' kept, '1d' -> missing
    assert inv0[0].meter_meter_active_power == 5.0 and inv0[0].ambient_temp == 30.0
    assert inv0[0].smu_total_strings == 2.0 and inv0[2].smu_string_mean == 0.0 and inv0[2].smu_string_std is None
    assert inv0[1].smu_num_zero == 0.0 and inv0[0].smu_num_zero == 1.0
    hourly = load_all_plants(spark, root).collect()
    h0 = {(r.inverter_id, r.datetime.hour): r for r in hourly}
    assert h0[("Plant_1_AA_INV0", 10)].inv_alarm_code == 1.0
    assert h0[("Plant_2_b_INV0", 10)].inv_kwh_today == 2.0  # last non-missing of the hour


def test_per_file_hourly_keeps_file_rows(spark):
    import os
    root = _tree()
    # a second file for the same logger id and hour
    with open(os.path.join(root, "Plant 2", "b2.csv"), "w") as fh:
        fh.write("timestamp,mac,inverters[0].power\n1709287260000,b,30\n")
    merged = load_all_plants(spark, root).where("inverter_id = 'Plant_2_b_INV0'").collect()
    split = load_all_plants(spark, root, per_file=True).where("inverter_id = 'Plant_2_b_INV0'").collect()
    assert len(merged) == 1 and merged[0].inv_power == 20.0  # (10 + 20 + 30) / 3
    assert sorted(r.inv_power for r in split) == [15.0, 30.0]


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(cols).collect()), key=repr) for d in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def _mixed_tree():
    root = _tree()
    extra = {("Plant 2", "b2.csv"): "timestamp,mac,inverters[0].power\n1709287260000,,30\n1709287260000,b,30\n",
             ("Plant 10", "q.csv"): '"timestampDate","meters[0].v, r",inverters[1].power,"inverters[1].note"\n2024-03-01 10:00:00,7,"1,5",x\n\n2024-03-01 10:10:00,8,2,"a ""b"""\n',
             ("Plant 10", "no_inverter.csv"): "timestamp,mac,meters[0].freq\n1709287260000,b,30\n", ("Plant 10", "notes.txt"): "x", ("Other", "a.csv"): H1 + R1[0]}
    for (d, name), text in extra.items():
        os.makedirs(os.path.join(root, d), exist_ok=True)
        with open(os.path.join(root, d, name), "w") as fh:
            fh.write(text)
    return root


def test_both_engines_agree(spark):
    root = _tree()
    for hourly in (False, True):
        _same(load_all_plants(spark, root, hourly=hourly), load_all_plants(spark, root, hourly=hourly, engine="csv"))


def test_source_reads_odd_files(spark):
    from fleetrisk.sources.telemetry_source import load_readings, scan
    root = _mixed_tree()
    rows = load_readings(spark, root).collect()
    by = {(r.inverter_id, r.datetime.minute): r for r in rows}
    assert by["Plant_10_q_INV1", 0]["meter_v, r"] == 7.0 and by["Plant_10_q_INV1", 0].inv_power is None and by["Plant_10_q_INV1", 10].inv_power == 2.0
    assert {r.logger_mac for r in rows} == {"AA", "b", "q"}  # b2 names its logger in its second row
    assert {r.file for r in scan(spark, root, headers=True).collect()} == {"a.csv", "b.csv", "b2.csv", "q.csv", "no_inverter.csv"}
    some = scan(spark, root, plants=["Plant_2"])
    assert {r.plant_id for r in some.collect()} == {"Plant_2"} and load_readings(spark, root, plants=["Plant_10"]).count() == 2


def test_thousands_of_files_are_one_scan(spark):
    import pytest

    from fleetrisk.sources.telemetry_source import TASK_FILES, FleetCsvReader, load_readings
    root = tempfile.mkdtemp(prefix="fleetrisk-many-")
    for i in range(2100):
        d = os.path.join(root, f"Plant {i % 7}")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, f"l{i}.csv"), "w") as fh:
            fh.write(f"timestamp,inverters[0].power,inverters[0].extra{i % 50}\n1709287200000,{i},1\n")
    shares = FleetCsvReader("file://" + root, False).partitions()
    assert len(shares) == -(-2100 // TASK_FILES) and sum(len(s.files) for s in shares) == 2100
    df = load_readings(spark, root)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan and "Join" not in plan
    assert df.count() == 2100 and len([c for c in df.columns if c.startswith("inv_extra")]) == 50
    reader = FleetCsvReader("file://" + root, False)
    from pyspark.sql.datasource import EqualTo
    assert list(reader.pushFilters([EqualTo(("plant_id",), "Plant_3")])) == [] and {p for s in reader.partitions() for p, _ in s.files} == {"Plant_3"}
    with pytest.raises(ValueError, match="No data"):
        load_readings(spark, tempfile.mkdtemp(prefix="fleetrisk-none-"))
