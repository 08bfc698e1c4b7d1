import json

from loomlog.operators import groups as G


def ev(seq, ts, member, event, generation=0, payload=None, protocols=("range",), session=1000, group="g"):
    return {"seq": seq, "ts_ms": ts, "group": group, "member": member, "event": event, "generation": generation, "session_ms": session, "protocols": list(protocols), "payload": payload}


def run(events, delay=0, **more):
    m = G.Machine("g", None, delay, **more)
    return m, [r for e in events for r in m.apply(e)]


def errors(rows, *keys):
    return [tuple(r[k] for k in ("event", "member", "error", *keys)) for r in rows]


def test_single_join_leads_itself():
    m, rows = run([ev(1, 0, "", "join")])
    assert errors(rows, "generation", "leader", "members") == [("join", "member-g-1", 0, 1, "member-g-1", "member-g-1")]
    assert m.g.state == G.AWAITING


def test_two_joins_share_a_round_with_one_leader():
    m, rows = run([ev(1, 0, "b", "join", protocols=("x", "range")), ev(2, 10, "a", "join", protocols=("range", "x"))], delay=100)
    assert rows == []
    rows = m.advance(100)
    assert errors(rows, "generation", "members", "protocol") == [("join", "a", 0, 1, "a,b", "range"), ("join", "b", 0, 1, "", "range")]


def test_sync_delivers_assignments_and_caches_them():
    both = [ev(1, 0, "a", "join"), ev(2, 0, "b", "join")]
    m, _ = run(both, delay=1)
    m.advance(1)
    rows = m.apply(ev(3, 2, "b", "sync", 1)) + m.apply(ev(4, 3, "a", "sync", 1, json.dumps({"a": "A", "b": "B"})))
    assert errors(rows, "assignment") == [("sync", "a", 0, "A"), ("sync", "b", 0, "B")] and m.g.state == G.STABLE
    assert errors(m.apply(ev(5, 4, "b", "sync", 1)), "assignment") == [("sync", "b", 0, "B")]
    assert errors(m.apply(ev(6, 5, "a", "heartbeat", 1))) == [("heartbeat", "a", 0)]
    assert errors(m.apply(ev(7, 6, "a", "heartbeat", 9))) == [("heartbeat", "a", 22)]
    assert errors(m.apply(ev(8, 7, "b", "leave"))) == [("leave", "b", 0)] and m.g.state == G.JOINING
    assert errors(m.apply(ev(9, 8, "a", "heartbeat", 1))) == [("heartbeat", "a", 27)]
    assert errors(m.apply(ev(10, 9, "a", "sync", 1))) == [("sync", "a", 27)]


def test_errors_of_unknown_groups_and_members():
    m, rows = run([ev(1, 0, "a", e, 1) for e in ("sync", "heartbeat", "leave", "commit")])
    assert [r["error"] for r in rows] == [15] * 4
    m, rows = run([ev(1, 0, "a", "join"), *(ev(2, 1, "z", e, 1) for e in ("sync", "heartbeat", "leave", "commit"))])
    assert [r["error"] for r in rows[1:]] == [25] * 4


def test_full_group_refuses_new_members_only():
    m, rows = run([ev(1, 0, "a", "join"), ev(2, 1, "", "join"), ev(3, 2, "b", "join")], max_members=1)
    assert errors(rows)[1] == ("join", "", 81) and "b" in m.g.members


def test_timers_expire_members_joins_and_syncs():
    m, _ = run([ev(1, 0, "a", "join")])
    assert errors(m.advance(1000)) == [("expire", "a", 0)] and m.g.state == G.EMPTY and m.g.leader == ""
    m, _ = run([ev(1, 0, "a", "join"), ev(2, 5, "b", "join", session=50)])
    assert errors(m.advance(60)) == [("join", "b", 27)] and list(m.g.members) == ["a"]
    m, _ = run([ev(1, 0, "a", "join"), ev(2, 5, "a", "sync", 1)])
    assert m.advance(1004) == [] and errors(m.advance(2000)) == [("sync", "a", 27), ("expire", "a", 0)]  # the sync at 5 began a new session


def test_sync_refreshes_the_session_and_the_round_does_not():
    m, _ = run([ev(1, 0, "a", "join"), ev(2, 900, "a", "sync", 1, json.dumps({"a": "A"}))])
    assert errors(m.apply(ev(3, 1500, "a", "heartbeat", 1))) == [("heartbeat", "a", 0)]
    m, _ = run([ev(1, 0, "a", "join")], delay=400)
    assert errors(m.advance(999)) == [("join", "a", 0)] and errors(m.advance(1000)) == [("expire", "a", 0)]


def test_assignments_of_members_that_are_not_listed_stay():
    m, _ = run([ev(1, 0, "a", "join"), ev(2, 0, "b", "join")], delay=1)
    m.advance(1)
    m.apply(ev(3, 2, "b", "sync", 1))
    m.apply(ev(4, 3, "a", "sync", 1, json.dumps({"a": "A", "b": "B"})))
    rows = m.apply(ev(5, 4, "a", "join")) + m.apply(ev(6, 5, "b", "join")) + m.advance(6)
    rows = m.apply(ev(7, 7, "b", "sync", 2)) + m.apply(ev(8, 8, "a", "sync", 2, json.dumps({"a": "A2"})))
    assert errors(rows, "assignment") == [("sync", "a", 0, "A2"), ("sync", "b", 0, "B")]


def test_leader_learns_what_members_say_of_the_protocol():
    m, _ = run([ev(1, 0, "a", "join", 0, '{"range": "of a", "other": "x"}'), ev(2, 0, "b", "join", 0, '{"range": "of b"}')], delay=1)
    rows = {r["member"]: r["metadata"] for r in m.advance(1)}
    assert rows == {"a": json.dumps({"a": "of a", "b": "of b"}), "b": None}


def test_state_survives_a_dump():
    m, _ = run([ev(1, 0, "a", "join"), ev(2, 1, "b", "join")], delay=50)
    n = G.Machine("g", G.Group.load(m.g.dump()), 50)
    assert n.advance(999) == m.advance(999)


def test_replay_equals_the_machine(spark):
    events = []
    for g in ("g", "h"):
        events += [ev(1, 0, "a", "join", group=g), ev(2, 5, "b", "join", group=g), ev(3, 200, "a", "sync", 1, json.dumps({"a": "A"}), group=g), ev(4, 210, "b", "sync", 1, group=g), ev(5, 300, "a", "commit", 1, "42", group=g), ev(6, 310, "a", "nonsense", group=g)]
    got = [r.asDict() for r in G.replay(spark.createDataFrame(events, G.EVENTS), 100, 5000).collect()]
    for g in ("g", "h"):
        m = G.Machine(g, None, 100)
        want = [r for e in events if e["group"] == g for r in m.apply(e)] + m.advance(5000)
        assert [r for r in got if r["group"] == g] == want
    assert G.committed(spark.createDataFrame(got, G.RESULTS)).count() == 2


def test_replay_goes_on_from_kept_states(spark):
    events = [ev(1, 0, "a", "join"), ev(2, 5, "b", "join"), ev(3, 200, "a", "sync", 1, json.dumps({"a": "A", "b": "B"})), ev(4, 210, "b", "sync", 1), ev(5, 300, "b", "leave", 1), ev(6, 400, "a", "heartbeat", 1)]
    plain = lambda df: sorted(map(str, df.filter("event <> 'state'").collect()))
    want = plain(G.replay(spark.createDataFrame(events, G.EVENTS), 100))
    states, got = None, []
    for e in events:
        out = G.replay(spark.createDataFrame([e], G.EVENTS), 100, states=states, keep=True)
        got += plain(out)
        states = spark.createDataFrame(G.states_of(out).collect(), "group string, state string")
    assert sorted(got) == want
