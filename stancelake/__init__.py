"""stancelake: stance analytics as Spark jobs.

functions/  Column -> Column libraries (cleaning, labels, replies, prompts)
operators/  DataFrame operators (sweep, scoring, topics, model steps, translation, evaluation)
sources/    schemas, IO, fixture tables derived from the driver tables
plans/      registered queries and their DuckDB twins
streaming/  resume by keys, streaming cleaning and counts
"""

__version__ = "0.1.0"
