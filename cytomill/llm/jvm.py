"""Java loops for columns, compiled by the compiler that Spark has for its own plans (Janino).

The source lies beside the modules; the driver compiles it once an application, and the executors get the classes as a jar
from the driver, as they get any other. Nothing has to be installed. It needs the driver's JVM beside it, so not a Spark Connect session.
"""

from __future__ import annotations

import os
import pkgutil
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_made: dict[tuple[str, str], object] = {}


def loader(spark: SparkSession, source: str):
    """The class loader of the compiled ``source``, whose classes executors have too."""
    sc = spark.sparkContext
    found = _made.get((sc.applicationId, source))
    if found is None:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data(__package__, source).decode())
        classes = compiler.getBytecodes()
        jar = os.path.join(sc._temp_dir, f"{source}-{uuid.uuid4().hex}.jar")  # this folder goes with the context
        with zipfile.ZipFile(jar, "w") as z:
            for name in classes:
                z.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        sc._jsc.addJar(jar)
        found = _made[sc.applicationId, source] = compiler.getClassLoader()
    return found


def instance(spark: SparkSession, source: str, name: str, prepare: Callable[[object], None]):
    """An object of the class ``name``; ``prepare`` gets it before it goes to the executors."""
    sc = spark.sparkContext
    made = loader(spark, source).loadClass(name).getDeclaredConstructor(sc._gateway.new_array(sc._jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(sc._jvm.java.lang.Object, 0))
    prepare(made)
    return made


def over_partitions(df: DataFrame, source: str, name: str, schema: str, prepare: Callable[[object], None]) -> DataFrame:
    """What the class ``name``, a Java function from a partition's rows to rows of ``schema``, makes of ``df``."""
    spark = df.sparkSession
    encoder = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.row(spark._jsparkSession.parseDataType(StructType.fromDDL(schema).json()))
    return DataFrame(df._jdf.mapPartitions(instance(spark, source, name, prepare), encoder), spark)


def function(spark: SparkSession, source: str, name: str, returns: str, prepare: Callable[[object], None]) -> Callable[..., Column]:
    """The class ``name``, a Java UDF, as a function of columns; ``prepare`` gets the object that goes to the executors.
    Spark evaluates it where it stands, once for each row. The class has ``function(DataType)``, which picks Spark's ``udf`` for its
    own interface: called from here, ``udf(Object, DataType)`` would fit as well, and which of them py4j takes is chance."""
    sc = spark.sparkContext
    made = instance(spark, source, name, prepare)
    kind = spark._jsparkSession.parseDataType(StructType.fromDDL(f"x {returns}")["x"].dataType.json())
    udf = made.function(kind).asNondeterministic()

    def of(*columns: str) -> Column:
        cols = sc._gateway.new_array(sc._jvm.org.apache.spark.sql.Column, len(columns))
        for i, c in enumerate(columns):
            cols[i] = F.col(c)._jc
        return Column(udf.apply(cols))

    return of
