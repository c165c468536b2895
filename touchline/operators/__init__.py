"""Panel features, ratings, joins and evaluation as DataFrame -> DataFrame functions."""
