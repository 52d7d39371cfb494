import pytest

from alertloom.sources import flows as L

FLOW = "\ufeffDur,Spkts,proto,state,attack_cat,srcip,Label\n1.5,3,tcp,CON,Normal,10.0.0.1,0\n,4,udp,,DoS,10.0.0.2,1\nNaN,5,,FIN,DoS,10.0.0.3,1\n"
EVENTS = "src_port,bytes_in,protocol,status,label\n80,1.5,http,failed,1\n,2,dns,success,0\n"


def put(folder, text, name="f.csv"):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_formats_are_told_apart(spark, tmp_path):
    flow = L.load_table(spark, put(tmp_path, FLOW))
    assert flow.columns == ["dur", "spkts", "proto_tcp", "proto_udp", "state_CON", "state_FIN", "label"]
    assert sorted(map(tuple, flow.collect())) == [(0.0, 4.0, 0, 1, 0, 0, 1), (0.0, 5.0, 0, 0, 0, 1, 1), (1.5, 3.0, 1, 0, 1, 0, 0)]
    events = L.load_table(spark, put(tmp_path, EVENTS, "e.csv"))
    assert sorted(r.asDict().items() for r in events.collect()) == sorted(
        d.items() for d in ({"label": 1, "src_port": 80.0, "bytes_in": 1.5, "status_failed": 1, "proto_dns": 0, "proto_http": 1},
                            {"label": 0, "src_port": 0.0, "bytes_in": 2.0, "status_failed": 0, "proto_dns": 1, "proto_http": 0}))


def test_other_views_and_missing_label(spark, tmp_path):
    df = L.read_flow_csv(spark, put(tmp_path, FLOW))
    assert L.numeric_flows(df).columns == ["dur", "spkts", "label"]
    named = L.renamed_flows(df)
    assert named.columns == ["duration", "spkts", "is_attack"]
    assert sorted(map(tuple, named.fillna(-1).collect())) == [(-1.0, 4.0, 1), (-1.0, 5.0, 1), (1.5, 3.0, 0)]
    for view in (L.numeric_flows, L.encoded_flows):
        with pytest.raises(ValueError, match="no label"):
            view(df.drop("label"))
    assert L.encoded_flows(df, ("srcip",)).where("srcip = '10.0.0.2'").first().spkts == 4.0


def test_broken_rows(spark, tmp_path):
    path = put(tmp_path, "dur,spkts,label\n1,2,0\nx,3,1\n4,5,1,9\n")
    assert {r.spkts for r in L.read_flow_csv(spark, path).collect()} == {2.0, 3.0, 5.0}
    assert [r.spkts for r in L.read_flow_csv(spark, path, "drop").collect()] == [2.0]
    with pytest.raises(Exception):
        L.read_flow_csv(spark, path, "fail").collect()
    with pytest.raises(ValueError):
        L.read_flow_csv(spark, path, "skip")
    with pytest.raises(ValueError, match="twice"):
        L.read_flow_csv(spark, put(tmp_path, "dur,Dur,spkts\n1,2,3\n", "t.csv"))


def test_header_alone_and_first_existing(spark, tmp_path):
    path = put(tmp_path, "dur,spkts,label\n")
    assert L.load_table(spark, path).count() == 0
    assert L.first_existing(spark, [str(tmp_path / "none.csv"), path]) == path
    with pytest.raises(FileNotFoundError):
        L.first_existing(spark, [str(tmp_path / "none.csv")])
