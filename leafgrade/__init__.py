"""leafgrade: workbook-page, answer-key and learner-log analytics on PySpark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected to the driver.
"""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with the query, so that
# executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
