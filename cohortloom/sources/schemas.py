"""Input columns: name in the file, our name, our type."""

from __future__ import annotations

# Column names of the enrolment file, in file order of the documented layout.
ENROLLMENTS = (
    ("PIDM", "sid", "long"),
    ("TERM_CODE", "term", "int"),
    ("HS_GRAD_YEAR", "hs_grad_year", "int"),
    ("ENROLLED_AFTER_HS_GRAD", "enrolled_after", "string"),
    ("EVER_ENROLLED_NON_CONCURRENT", "ever_nonconcurrent", "string"),
    ("ENROLLED_WITHIN_ONE_YR_OF_HS", "within_one_year", "string"),
    ("FIRST_NAME", "first_name", "string"),
    ("MIDDLE_NAME", "middle_name", "string"),
    ("LAST_NAME", "last_name", "string"),
    ("BIRTH_DATE", "birth_date", "date"),
    ("BANNER_ID", "inst_id", "string"),
    ("GENDER", "gender", "string"),
    ("ETHNICITY", "ethnicity", "string"),
    ("COURSE_SUBJECT", "subject", "string"),
    ("COURSE_NUMBER", "course_no", "string"),
    ("COURSE_SECTION", "section", "string"),
    ("CRN", "crn", "string"),
    ("PRIMARY_INSTRUCTOR_PIDM", "instructor_id", "long"),
    ("FINAL_GRADE", "final_grade", "string"),
    ("ADDRESS_ZIP", "address_zip", "string"),
    ("HIGH_SCHOOL", "high_school", "string"),
    ("AGE_ON_FIRST_DAY", "age_first_day", "int"),
)
# What the second extract adds.
ENROLLMENTS_V2 = ENROLLMENTS + (
    ("CAMPUS", "campus", "string"),
    ("EVER_PELL_ELIGIBLE_IND", "pell_eligible", "string"),
    ("FIRST_GENERATION_IND", "first_generation", "string"),
)
# Column names of the spell file.
SPELLS = (
    ("Requester.Return.Field", "sid", "long"),
    ("First.Name", "first_name", "string"),
    ("Last.Name", "last_name", "string"),
    ("Record.Found.Y.N", "record_found", "string"),
    ("College.Name", "college", "string"),
    ("Enrollment.Begin", "begin_ymd", "int"),
    ("Graduated.", "graduated", "string"),
    ("Degree.Title", "degree_title", "string"),
)
