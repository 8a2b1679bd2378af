"""The dialect's value semantics as Spark columns."""
