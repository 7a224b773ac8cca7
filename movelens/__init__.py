"""movelens: Spark-native analytics over moves and the spells they start.

A *move* takes a subject from one organisation to another; the *spell* it
starts lasts until the subject's next move. The package turns raw move,
activity and valuation tables into scored spells, and answers browse, report,
trend, prediction and explanation queries over them. Every operator takes and
returns DataFrames and is generic over column names.
"""
