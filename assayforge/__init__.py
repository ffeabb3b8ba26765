"""Molecule-assay data preparation, scoring and evaluation as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package used inside UDFs travel with the job: executors need no install of it.
register_pickle_by_value(sys.modules[__name__])
