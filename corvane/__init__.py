"""Code-comprehension analytics as DataFrame operators.

``corvane.plans.workspace.Workspace`` is the entry point for source trees; the modules in
``corvane.operators`` are generic DataFrame-to-DataFrame functions that take column names.
"""
