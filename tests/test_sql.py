from cloudloom import sql


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT st_loa_band(0.004) AS loa, st_in_obb(0.4D,0D,0D, 0D,0D,0D, 1D,1D,1D, 0D,0D,0D) AS a, st_in_obb(0.6D,0D,0D, 0D,0D,0D, 1D,1D,1D, 0D,0D,0D) AS b,"
        " st_in_prism(0.2D,0.5D,0.2D, array(array(0D,0D),array(1D,0D),array(0D,1D)), 0D, 1D) AS c, st_in_prism(0.9D,0.5D,0.9D, array(array(0D,0D),array(1D,0D),array(0D,1D)), 0D, 1D) AS d,"
        " st_in_tube(0.5D,0.1D,0D, array(array(0D,0D,0D),array(1D,0D,0D)), 0.2D) AS e, st_in_tube(0.5D,0.3D,0D, array(array(0D,0D,0D),array(1D,0D,0D)), 0.2D) AS f"
    ).first()
    assert tuple(row) == ("LOA40", True, False, True, False, True, False)
    assert spark.sql("SELECT * FROM explode_cells(0D, 0D, 0D, 1.5D, 0.5D, 0.5D, 1D)").count() == 2
