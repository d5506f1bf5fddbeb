"""fathomset: calibrated classification and design audit of labelled measurement tables, as Spark jobs.

Conventions used by every operator
----------------------------------
* long fact      ``sample_id, feature_id, value`` (plus ``group_id``, ``class``, ``assay`` where needed)
* ``group_id``   the individual behind a sample; the unit of every split and resample
* missing        SQL NULL, never NaN; an absent long row is "not measured" (0 only on counts)
* randomness     a keyed md5 hash, so results depend on neither row order nor partitioning
* ties           always broken explicitly, by identifier
"""

__version__ = "0.1.0"
