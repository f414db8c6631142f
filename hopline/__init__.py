"""hopline: timetable analytics and corpus preparation on PySpark."""
