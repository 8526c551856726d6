"""Operators for preparing training data: sharding, near-duplicate and substring
removal, decontamination, scans, search, quality scoring, packing, privacy.

Each module holds one operator with its general interface; ``queries`` binds
them to the tables with fixed result columns. Nothing outside this subpackage
(and ``corpus_pipeline.py``) imports it.

Common rules, for every operator:

* a NULL text is an empty text; a NULL id is a value like any other (compared
  null-safely, ordered after every id);
* repeated rows are kept: one result row per input row unless an operator
  says otherwise;
* other columns of the input are ignored or passed through, whatever their
  names; an empty table gives an empty result with the same schema.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them, so executors need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
