from lattica.operators import imports as I


def files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def uses(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, import_path string")


def targets(candidates, f):
    return sorted((r.import_path, r.target) for r in I.find(candidates, f).collect())


def test_jvm(spark):
    f = files(spark, "src/com/a/B.java", "src/com/a/C.java", "src/com/a/sub/D.java", "tests/MyGame/Example/Monster.java", "tests/MyGame/Example2/Monster.java", "src/com/a/M.java")
    i = uses(spark, *[("src/com/a/M.java", x) for x in ("com.a.*", "com.a.B", "com.a.B.make", "com.a.B.SIZE", "MyGame.Sample.Monster", "org.Missing", "com.a.c")])
    assert targets(I.jvm(i), f) == [
        ("MyGame.Sample.Monster", "tests/MyGame/Example2/Monster.java"), ("com.a.*", "src/com/a/B.java"), ("com.a.*", "src/com/a/C.java"),
        ("com.a.B", "src/com/a/B.java"), ("com.a.B.SIZE", "src/com/a/B.java"), ("com.a.B.make", "src/com/a/B.java"), ("com.a.c", "src/com/a/C.java")]


def test_go(spark):
    f = I.go_sources(files(spark, "pkg/api/api.go", "pkg/api/api_test.go", "pkg/api/internal.go", "pkg/api/v2/x.go", "pkg/apis/y.go", "main.go"))
    m = spark.createDataFrame([("example.com/project",)], "module string")
    i = uses(spark, ("main.go", "example.com/project/pkg/api"), ("main.go", "fmt"), ("main.go", "example.com/project"))
    assert [t for _, t in targets(I.go(i, m), f)] == ["pkg/api/api.go", "pkg/api/internal.go", "pkg/api/v2/x.go"]


def test_csharp(spark):
    f = files(spark, "app/Models/Message.cs", "app/Models/Other.cs", "app/Models/Deep/X.cs", "app/Main.cs", "lib/Tool.cs")
    p = spark.createDataFrame([("My.App", "app")], "root_namespace string, project_dir string")
    i = uses(spark, *[("app/Start.cs", x) for x in ("My.App.Models.Message", "My.App.Models", "My.App", "Else.Tool", "System.Text")])
    assert targets(I.csharp(i, p), f) == [
        ("Else.Tool", "lib/Tool.cs"), ("My.App", "app/Main.cs"), ("My.App.Models", "app/Models/Message.cs"), ("My.App.Models", "app/Models/Other.cs"), ("My.App.Models.Message", "app/Models/Message.cs")]


def test_php(spark):
    f = files(spark, "src/Plugin.php", "src/Plugins/UI/Master.php")
    psr4 = spark.createDataFrame([("LaravelLang\\Lang\\", "src/")], "prefix string, dir string")
    i = uses(spark, ("a.php", "LaravelLang\\Publisher\\Plugins\\Plugin"), ("a.php", "LaravelLang\\Lang\\Plugin"), ("a.php", "LaravelLang\\Lang\\Plugins\\UI\\Master"))
    assert targets(I.php(i, psr4), f) == [("LaravelLang\\Lang\\Plugin", "src/Plugin.php"), ("LaravelLang\\Lang\\Plugins\\UI\\Master", "src/Plugins/UI/Master.php")]
    assert targets(I.php(i), f)[-1] == ("LaravelLang\\Publisher\\Plugins\\Plugin", "src/Plugin.php")


def test_rust(spark):
    f = files(spark, "crates/cli/src/decompress.rs", "crates/cli/src/process.rs", "src/process.rs", "src/a/mod.rs", "src/a/b.rs", "src/x.rs")
    i = uses(spark, ("crates/cli/src/decompress.rs", "crate::process::{CommandError, Reader}"), ("src/decompress.rs", "crate::process::CommandReaderBuilder"), ("src/decompress.rs", "std::{io, path}"),
        ("src/a/b.rs", "super::x"), ("src/a/c.rs", "self::b::T;"), ("src/main.rs", "crate::a"))
    got = {(r.file_path, r.import_path): r.target for r in I.find(I.rust(i), f).collect()}
    assert got == {("crates/cli/src/decompress.rs", "crate::process::{CommandError, Reader}"): "crates/cli/src/process.rs", ("src/decompress.rs", "crate::process::CommandReaderBuilder"): "src/process.rs",
        ("src/a/b.rs", "super::x"): "src/x.rs", ("src/a/c.rs", "self::b::T;"): "src/a/b.rs", ("src/main.rs", "crate::a"): "src/a/mod.rs"}


def test_aliases(spark):
    f = files(spark, "web/src/ui/button.tsx", "web/src/lib/index.ts")
    s = spark.createDataFrame([("@/", "./src/", "web")], "alias string, target string, base_url string")
    assert targets(I.aliases(uses(spark, ("web/a.ts", "@/ui/button"), ("web/a.ts", "@/lib"), ("web/a.ts", "react")), s), f) == [("@/lib", "web/src/lib/index.ts"), ("@/ui/button", "web/src/ui/button.tsx")]


def test_implicit_packages(spark):
    rows = [("java/A.java", "java", "package sample; class A {}"), ("java/B.java", "java", "package sample; class B {}"), ("cs/A.cs", "csharp", "namespace Sample; class A {}"), ("cs/B.cs", "csharp", "namespace Sample { class B {} }"),
        ("cs/Other.cs", "csharp", "namespace Other; class Other {}"), ("Sources/Core/A.swift", "swift", ""), ("Sources/Core/Nested/B.swift", "swift", None), ("Sources/Other/C.swift", "swift", ""), ("Tests/CoreTests/A.swift", "swift", ""), ("x.go", "go", "package x")]
    got = {r.file_path: r.package for r in I.implicit_packages(spark.createDataFrame(rows, "path string, language string, content string")).collect()}
    assert got["java/A.java"] == got["java/B.java"] == "java:sample" and got["cs/A.cs"] == got["cs/B.cs"] == "csharp:Sample" != got["cs/Other.cs"]
    assert got["Sources/Core/A.swift"] == got["Sources/Core/Nested/B.swift"] and len({v for k, v in got.items() if k.endswith("swift")}) == 3 and "x.go" not in got


def test_re_exports(spark):
    rows = [("app.ts", "Button", "index.ts", "Button"), ("index.ts", "Button", "ui/index.ts", "Base"), ("ui/index.ts", "Base", "ui/base.ts", "Base"), ("l1.ts", "X", "l2.ts", "X"), ("l2.ts", "X", "l1.ts", "X"), ("b.ts", "Y", "c.ts", "Y")]
    got = {(r.file_path, r.local_name): (r.target, r.exported_name) for r in I.re_exports(spark.createDataFrame(rows, "file_path string, local_name string, target string, exported_name string")).collect()}
    assert got["app.ts", "Button"] == ("ui/base.ts", "Base") and got["b.ts", "Y"] == ("c.ts", "Y") and got["l1.ts", "X"][0] == "l2.ts"
