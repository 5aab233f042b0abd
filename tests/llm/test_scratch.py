"""Scratch folders of callers in several threads of one driver."""

import threading

from postmill.llm.common import scratch, stored


def test_threads_have_scratch_of_their_own(spark):
    gate, out, errors = threading.Barrier(2), {}, []

    def first():
        with scratch(spark):
            gate.wait()  # both are inside
            df = stored(spark.range(10), "a")
            gate.wait()
            gate.wait()  # the other has written and left
            out["first"] = df.count()

    def second():
        with scratch(spark):
            gate.wait()
            gate.wait()
            out["second"] = stored(spark.range(20), "b").count()
        gate.wait()

    def guarded(f):
        try:
            f()
        except Exception as e:
            errors.append(e)
            gate.abort()

    threads = [threading.Thread(target=guarded, args=(f,)) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and out == {"first": 10, "second": 20}


def test_scopes_nest(spark):
    with scratch(spark):
        outer = stored(spark.range(3), "a")
        with scratch(spark):
            assert stored(spark.range(4), "b").count() == 4
        assert outer.count() == 3 and stored(spark.range(5), "c").count() == 5
