"""Streams with state, scanned files and web pages."""

from tessera.sources import tables
from tessera.streaming import conversations


def test_late_turns_find_their_place(spark, tmp_path):
    """Two batches: the second brings a turn that belongs before one that was already given out."""
    columns = "conv_id long, turn long, role string, text string"
    batch = lambda *rows: spark.createDataFrame([(c, t, "user", f"m{t}") for c, t in rows], columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    batch((1, 3), (1, 0), (1, 1), (2, 5))
    batch((1, 2), (1, 4), (None, 1))
    rows = {(r.conv_id, r.turn): [m.seq for m in r.history] for r in conversations.run_histories(spark, str(tmp_path / "t.parquet"), last=3, batch_files=1).collect()}
    assert rows == {(1, 0): [], (1, 1): [0], (1, 3): [0, 1], (2, 5): [], (1, 2): [0, 1], (1, 4): [1, 2, 3], (None, 1): []}


class Known:
    """A processor's state and timers, without a stream."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_quiet_conversations_are_forgotten():
    import pandas as pd

    state, said = Known(), conversations.Remembered(quiet_ms=50)
    said.init(state)
    for turn in (1, 2):
        list(said.handleInputRows((7,), iter([pd.DataFrame({"turn": [turn], "role": ["user"], "text": ["x"]})]), state))
    assert state.timers == [1050] and len(state.rows) == 2
    list(said.handleExpiredTimer((7,), state, None))
    (out,) = said.handleInputRows((7,), iter([pd.DataFrame({"turn": [3], "role": ["user"], "text": ["y"]})]), state)
    assert out["history"].tolist() == [[]]


def test_files_that_can_not_be_parsed(spark, tmp_path):
    for name, content in (("a.txt", b"one\ftwo"), ("b.pdf", b"%PDF-1.7 /Encrypt x"), ("c.txt", b""), ("d.pdf", b"%PDF-1.4 fine")):
        (tmp_path / name).write_bytes(content)
    rows = {r.document: r for r in tables.scanned(spark, str(tmp_path)).collect()}
    assert {n: r.rejected for n, r in rows.items()} == {"a.txt": None, "b.pdf": "encrypted", "c.txt": "empty", "d.pdf": None}
    assert rows["b.pdf"].content is None and bytes(rows["d.pdf"].content) == b"%PDF-1.4 fine"
    pages = tables.pages(spark, str(tmp_path), lambda content: content.decode().split("\f")).collect()
    assert sorted((r.document, r.page, r.text) for r in pages) == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("d.pdf", 1, "%PDF-1.4 fine")]


def test_web_pages(spark):
    html = "<html><title>T &amp; U</title><!-- <p>no</p> --><script>var a='<p>';</script><p>one<br/>two &lt;b&gt; &amp;lt;</p><STYLE>p{}</STYLE><div>three</div></html>"
    rows = spark.createDataFrame([(1, "https://A.org/x?y", html), (2, None, None)], "page_id long, url string, html string")
    got = {r.page: (r.document, r.text) for r in tables.web_pages(rows).collect()}
    assert got == {1: ("a.org", "T & U\none\ntwo <b> &lt;\nthree\n"), 2: ("", "")}
