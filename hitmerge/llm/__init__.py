"""Operators that turn pools of search hits into training data.

Nothing else in the library imports this subpackage. Hits are named by ``hit_ord``; a table of many
rounds first gets one number per row (``hitmerge.operators.numbering``)."""
