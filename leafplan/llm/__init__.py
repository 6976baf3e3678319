"""Operators for preparing training data at corpus scale.

Conventions that hold for every operator here:

* Output columns of an operator win over input columns of the same name (names
  are compared without case); all other input columns pass through untouched.
* A null text counts as an empty text unless the operator says otherwise.
* Repeated rows stay repeated rows; nothing is dropped, capped or sampled
  unless dropping is what the operator is for.
* Intermediate tables go to the folder in ``spark.checkpoint.dir``, which all
  executors share.
"""
