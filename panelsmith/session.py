"""Spark session with the settings the operators rely on."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Adaptive execution is what turns the unhinted joins of this package into
# broadcasts when a side is measured to be small, and what splits a hot key
# when it is not.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Sessions of a busy key are merged where they are read, before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Keeps streaming state on local disk, backed up to the checkpoint, instead of in executor memory.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cluster_session(app: str = "panelsmith") -> SparkSession:
    """Session for a cluster: master, memory and partitions come from submit."""
    return _with_settings(SparkSession.builder.appName(app).config(STATE_STORE, ROCKSDB)).getOrCreate()


def local_session(cpus: int | str = 8, memory: str = "12g", app: str = "panelsmith") -> SparkSession:
    """Session for tests and the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = _with_settings(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def return_memory(spark: SparkSession) -> bool:
    """Give the system back what the driver's JVM has freed outside its heap; False where the JVM has no such command.

    glibc keeps freed memory in arenas, up to eight for each core, and a driver
    that plans many jobs with hundreds of threads gathers some 200 MB there.
    This is ``jcmd <pid> System.trim_native_heap``, by the JVM's management
    interface.  A session whose driver starts with ``MALLOC_ARENA_MAX`` of few
    arenas has little to return.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    classes, given = new_array(jvm.java.lang.Class, len(kinds)), new_array(jvm.java.lang.Object, len(kinds))
    for i, kind in enumerate(kinds):
        classes[i] = jvm.java.lang.Class.forName(kind)
    given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given[1] = "systemTrimNativeHeap"
    # The server's own class is not public, so its method is taken from the interface.
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", classes)
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:  # another JVM, or another system than Linux
        return False
    return True


def _with_settings(builder):
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
