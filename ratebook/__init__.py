"""Price-transparency analytics as PySpark DataFrame operators.

Sub-packages
------------
``functions``  column -> column expressions (cleaning, rules, similarity, aggregates)
``sources``    readers and writers for published price files, registries and tables
``operators``  DataFrame -> DataFrame building blocks (joins, reshape, matching, checks, models)
``plans``      composed jobs: normalization, facility resolution, reports, marts
``registry``   the queries exposed through ``__spark_entry__`` with their SQL twins
"""
