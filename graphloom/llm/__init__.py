"""Operations on text corpora for training data.

Nothing outside this subpackage imports it. Conventions that hold for all of it:

* ``doc_id`` names a document. Rows in which ``doc_id`` or ``text`` is null take no
  part in searches and appear in no result of a search; operators that return a row
  per document say what they return for them.
* Only the columns an operator names are read, so further columns, whatever they are
  called, can't clash with its own.
* Rows that repeat a ``doc_id`` are one document unless an operator says otherwise.
* An empty table gives an empty result of the same schema.
"""
