"""sparsegrad: iterative logistic-regression learners over sparse labelled
rows, built on Spark DataFrames.

    from sparsegrad.sources import text, fixtures
    from sparsegrad.operators import linear, dual, sample, update, norms
    from sparsegrad.plans import trainers
"""

__version__ = "0.1.0"
