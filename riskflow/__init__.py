"""riskflow: payment-risk analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a column
expression) built from Spark SQL / DataFrame primitives so Catalyst can prune,
push down and fuse it.  Modules:

* ``riskflow.session``      session defaults, checkpoint folder
* ``riskflow.bindings``     domain views over the driver tables
* ``riskflow.sources``      readers and writers (CSV, Parquet, JSON, logs)
* ``riskflow.functions``    scalar column builders (time, email, bands, text)
* ``riskflow.operators``    windows, aggregates, joins, evaluation, rules,
                            vectors, gate, library quality, models
* ``riskflow.plans``        composed jobs (feature build, rule generation,
                            case files, case mining)
* ``riskflow.streaming``    Structured Streaming versions of the live path
"""

__version__ = "0.1.0"
