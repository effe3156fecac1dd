"""Training-data pipeline operators.

One module per operator; ``queries`` registers them. Nothing outside this
package (and ``corpus_pipeline.py``) imports it.
"""
