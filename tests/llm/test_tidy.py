"""What finished steps leave behind on executors."""

import re
import time

import corpus_pipeline
from siftlake.llm import common, tokens


def test_executors_collect_their_garbage(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    old = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = old()
    common.tidy_executors(spark)  # a local master's executor is the driver's JVM
    assert old() > before


def test_the_drivers_jvm_gives_freed_native_memory_back(spark):
    java = spark._jvm.java.lang
    field = java.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, size = field.get(None), 100_000
    status = f"/proc/{java.ProcessHandle.current().pid()}/status"
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", open(status).read())[1]) / 1024
    blocks = [unsafe.allocateMemory(size) for _ in range(4000)]
    for b in blocks:
        unsafe.setMemory(b, size, 1)
    for i, b in enumerate(blocks):
        if i % 50:  # those that stay keep the C library from giving back whole ends
            unsafe.freeMemory(b)
    for _ in range(3):
        java.System.gc()
    time.sleep(2)  # so that the heap has shrunk already
    before = resident()
    common.tidy(spark)
    after = resident()
    for b in blocks[::50]:
        unsafe.freeMemory(b)
    assert after < before - 200


def test_a_worker_forgets_its_encoders():
    tokens.encoder(tokens.default_vocabulary())
    assert tokens._ENCODERS
    tokens.forget()
    assert not tokens._ENCODERS


def python_nodes(spark, step):
    """Python nodes in the plans of all that a step runs."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def plans():
        bus.waitUntilEmpty()
        runs = store.executionsList()
        return {r.executionId(): r.physicalPlanDescription() for r in (runs.apply(i) for i in range(runs.size()))}

    before = set(plans())
    step()
    new = {k: p for k, p in plans().items() if k not in before}
    assert new
    return set(re.findall(r"\b\w*(?:MapIn|EvalPython|InPandas|InArrow)\w*", "\n".join(new.values())))


def test_native_stages_run_no_python_on_executors(spark, tmp_path):
    rows = [(i, f"u{i}", f"s{i % 3}", "en", f"{i // 2} word word") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, source string, lang string, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    docs, stages = spark.read.parquet(f"{tmp_path}/docs"), dict(corpus_pipeline.STAGES)

    def run(name):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")

    for name in ("exact dedup", "mixing sources to target weights"):
        assert python_nodes(spark, lambda: run(name)) == set()
    assert "MapInArrow" in python_nodes(spark, lambda: run("SimHash near-dedup"))
    assert "MapInArrow" in python_nodes(spark, lambda: common.tidy_executors(spark, workers=True))
