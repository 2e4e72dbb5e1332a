"""The analyses, each a function from DataFrames to the dataset it reports.

Tables and their columns (every name can be produced by a select on the caller's side):

``ce``      enrolments: sid, term, and what the analysis names
``spells``  college spells: sid, term, college, graduated, ...
``rollup``  one row per student, from ``enrolment.student_rollup``
``linked``  spells with the student's rollup, from ``linkage.linked_spells``

``sid`` is never missing; every other column may be.
"""
